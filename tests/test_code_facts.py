"""Detectors over code facts: for each rule of each detector a file that it finds and one that it leaves alone."""

import pytest

from thornwick.operators import code_facts

FILES = "pkg string, path string, content string, is_fixture boolean"
HEX = r"\x41\x42\x43\x44"
CODES, BOXES = ("".join(f"\\u{ord(c):04x}" for c in x) for x in ("proc", chr(0x2500) * 9))
PACKED = "a=b+c;" * 150
RUNS = "exec(c);"

#: detector, code, path, findings (severity, confidence, description).
CASES = [
    ("filesystem-access", "import fs from 'fs';", "a.js", [("medium", 1.0, 'Imports filesystem module "fs"')]),
    ("filesystem-access", "const f = require('node:fs');", "a.js", [("medium", 1.0, 'Requires filesystem module "node:fs"')]),
    ("filesystem-access", "const f = require(fs);", "a.js", []),
    ("filesystem-access", "fs.opendir('x');", "a.js", [("medium", 0.85, "Filesystem read operation: opendir()")]),
    ("filesystem-access", "fs.promises.chown('x');", "a.js", [("medium", 0.85, "Filesystem write/delete operation: chown()")]),
    ("filesystem-access", "truncate(x); realpath(y);", "a.js", []),
    ("filesystem-access", "store.watch(x);", "a.js", [("medium", 0.85, "Filesystem read operation: watch()")]),
    ("filesystem-access", "fs.readFileSync('~/.ssh/id');", "a.js", [("high", 0.95, "Reads from sensitive path: ~/.ssh/id")]),
    ("filesystem-access", "fs.rm(`/home/${u}/.aws`);", "a.js", [("critical", 0.95, "Writes/deletes to sensitive path: `/home/${u}/.aws`")]),
    ("filesystem-access", "const p = '~/.npmrc';", "a.js", [("high", 0.8, "References sensitive path: ~/.npmrc")]),
    ("filesystem-access", "f('~/.npmrc'); g(['~/.npmrc']);", "a.js", []),
    ("network-access", "import x from \"got\";", "a.js", [("medium", 1.0, 'Imports network module "got"')]),
    ("network-access", "require('undici')", "a.js", [("medium", 1.0, 'Requires network module "undici"')]),
    ("network-access", "http.createServer(f)", "a.js", [("low", 1.0, "Creates local server: http.createServer()")]),
    ("network-access", "axios.patch(u); got.delete(u); dns.lookup(u); axios.head(u)", "a.js", [("medium", 0.8, "Network call: axios.patch()"), ("medium", 0.8, "Network call: got.delete()")]),
    ("network-access", "fetch('https://evil.io/x')", "a.js", [("high", 0.9, "Makes HTTP request via fetch()")]),
    ("network-access", "fetch('http://127.0.0.1:3/x')", "a.js", [("low", 0.8, "Makes HTTP request via fetch() (targets localhost)")]),
    ("network-access", "http.get({host: 'evil.io', port: 1})", "a.js", [("high", 0.9, "Network call: http.get()")]),
    ("network-access", "import a from 'fs'; fetch(u)", "a.js", [("medium", 0.8, "Makes HTTP request via fetch() (co-occurs with filesystem access)")]),
    ("network-access", "post(u)", "a.js", []),
    ("network-access", "import 'http'; post(u)", "a.js", [("medium", 1.0, 'Imports network module "http"'), ("medium", 0.8, "Network call: post()")]),
    ("network-access", "new WebSocket(u); WebSocket(u)", "a.js", [("high", 0.9, "Opens WebSocket connection")]),
    ("network-access", "new URL('https://evil.io/a'); new URL('https://github.com/a'); new URL(x)", "a.js", [("medium", 0.7, "Constructs URL to external host: evil.io")]),
    ("env-access", "process.env.HOME", "a.js", [("info", 0.95, "Reads environment variable: HOME")]),
    ("env-access", "process.env.MY_TOKEN", "a.js", [("low", 0.95, "Reads sensitive environment variable from process.env: MY_TOKEN")]),
    ("env-access", "process.env.TOKENIZER_X", "a.js", [("info", 0.95, "Reads environment variable: TOKENIZER_X")]),
    ("env-access", "process.env['HOME']", "a.js", [("info", 0.95, "Reads environment variable via bracket notation: HOME")]),
    ("env-access", "process.env[k]", "a.js", [("high", 0.9, "Dynamic environment variable access with computed key")]),
    ("env-access", "const { A, B: c } = process.env;", "a.js", [("medium", 0.95, "Destructures process.env: A, c")]),
    ("env-access", "const { A, API_KEY } = process.env;", "a.js", [("low", 0.95, "Destructures sensitive vars from process.env: API_KEY")]),
    ("env-access", "const { a, b, c, d, e, f } = process.env;", "a.js", [("high", 0.95, "Bulk destructuring of process.env (6 variables)")]),
    ("env-access", "const e = process.env;", "a.js", [("high", 0.9, "Assigns entire process.env to a variable (bulk access)")]),
    ("env-access", "x = {...process.env}", "a.js", [("high", 0.9, "Spreads entire process.env (bulk access)")]),
    ("env-access", "Object.entries(process.env)", "a.js", [("high", 0.95, "Enumerates all environment variables via Object.entries(process.env)")]),
    ("env-access", "proc.env.A; process.environment", "a.js", []),
    ("process-spawn", "import { exec } from 'child_process';", "a.js", [("critical", 1.0, 'Imports child_process module "child_process"')]),
    ("process-spawn", "require('vm')", "a.js", [("critical", 1.0, 'Requires VM module "vm"')]),
    ("process-spawn", "require('worker_threads')", "a.js", [("high", 0.9, "Requires worker_threads — can execute code in isolated threads")]),
    ("process-spawn", "exec('ls')", "a.js", [("critical", 0.85, "Spawns child process: exec()")]),
    ("process-spawn", "cp.spawn('a' + b)", "a.js", [("critical", 0.95, "Command injection risk: spawn() called with dynamic string argument")]),
    ("process-spawn", "re.exec(x)", "a.js", []),
    ("process-spawn", "vm.runInContext(x)", "a.js", [("critical", 0.95, "Executes code in VM context: vm.runInContext()")]),
    ("process-spawn", "eval(x)", "a.js", [("critical", 0.9, "Uses eval() for code execution")]),
    ("process-spawn", "eval(`a${x}`)", "a.js", [("critical", 0.9, "Uses eval() with dynamic string construction")]),
    ("process-spawn", "new Function('x'); Function('y')", "a.js", [("critical", 0.95, "Creates function from string via Function constructor")]),
    ("crypto-usage", "import c from 'crypto';", "a.js", [("low", 0.8, 'Imports crypto module "crypto"')]),
    ("crypto-usage", "import c from 'crypto'; import h from 'http';", "a.js", [("high", 0.8, 'Imports crypto module "crypto" (co-occurs with network access)')]),
    ("crypto-usage", "require('crypto'); c.createHash('x')", "a.js", [("low", 0.6, "Crypto operation: createHash()")]),
    ("crypto-usage", "c.createHash('x')", "a.js", []),
    ("crypto-usage", "b.toString('base64'); b.toString('hex')", "a.js", [("low", 0.5, "Base64 encoding")]),
    ("crypto-usage", "Buffer.from(x, 'base64'); Buffer.from(x)", "a.js", [("low", 0.7, "Base64 decoding via Buffer.from")]),
    ("crypto-usage", "require('http'); atob(x)", "a.js", [("high", 0.75, "atob() near network code (potential data encoding for exfiltration)")]),
    ("obfuscation", "String.fromCharCode(1)", "a.js", [("high", 0.6, "Uses String.fromCharCode (potential string obfuscation)")]),
    ("obfuscation", "String.fromCharCode(1);" * 4, "a.js", [("critical", 0.9, "Heavy String.fromCharCode usage (4 calls) — likely obfuscated strings")]),
    ("obfuscation", "s.fromCharCode(1)", "a.js", []),
    ("obfuscation", "process['env']", "a.js", [("critical", 0.9, "Bracket notation access: process['env'] (obfuscation technique to evade static analysis)")]),
    ("obfuscation", "constructor[x]", "a.js", [("critical", 0.85, "Dynamic bracket notation access on constructor (obfuscation technique)")]),
    ("obfuscation", "const window = []; window[0]; a.process['x']; other['y']", "a.js", []),
    ("obfuscation", f"x = '{HEX}'; y = '{HEX[:8]}'", "a.js", [("critical", 0.85, "Hex-escaped string with 4 escape sequences (obfuscated content)")]),
    ("obfuscation", f"x = `{HEX}`; y = `{HEX}${{z}}`", "a.js", [("critical", 0.85, "Hex-escaped template literal with 4 escape sequences")]),
    ("obfuscation", f"x = '{CODES}'; y = '{BOXES}'", "a.js", [("critical", 0.85, "Unicode-escaped string with 4 ASCII-identifier escapes (string obfuscation)")]),
    ("obfuscation", f"z\n{PACKED}", "a.js", [("critical", 0.75, "Very long single-line expression (900 chars) — possibly minified or obfuscated code")]),
    ("obfuscation", f"// {PACKED}\nconst p = '{PACKED}';\nreturn `{PACKED}`;\nf('{PACKED}')\n{PACKED[:700]}\n{'word ' * 200}\nexport {PACKED}", "a.js", []),
    ("obfuscation", "eval('a' + b)", "a.js", [("critical", 0.95, "eval() with string concatenation/template — obfuscated code execution")]),
    ("install-scripts", f"fetch(u); {RUNS}", "lib/a.js", [("low", 0.3, "File has both network fetch and code execution (common in tools/servers)")]),
    ("install-scripts", f"got(u); {RUNS}", "scripts/postinstall.js", [("critical", 0.9, "Download-and-execute pattern: got() with subsequent code execution in install script")]),
    ("install-scripts", f"validate(u); fetch(u); {RUNS}", "lib/a.js", []),
    ("install-scripts", f"validate(u); fetch(u); {RUNS}", "install.js", [("critical", 0.9, "Download-and-execute pattern: fetch() with subsequent code execution in install script")]),
    ("install-scripts", "http.get(u, r => r.pipe(fs.createWriteStream(p)))", "a.js", [("critical", 0.9, "Pipes downloaded content to execution or file write")]),
    ("install-scripts", "http.get(u, r => r.pipe(out)); a.pipe(x)", "a.js", []),
    ("install-scripts", "p.then(eval); p.then(f)", "a.js", [("critical", 0.95, "Promise chain passes downloaded content directly to eval/Function")]),
    ("install-scripts", "p.then(t => { return new Function(t)() })", "a.js", [("critical", 0.95, "Promise chain passes downloaded content directly to eval/Function")]),
    ("install-scripts", "execSync('curl x'); execSync('ls')", "a.js", [("critical", 0.95, "Shell execution with download command: execSync() contains URL or curl/wget")]),
    (
        "install-scripts", f"validate(); fetch(u); fs.createWriteStream(p); {RUNS}", "a.js", [("medium", 0.3, "File has download, write, and execute calls (common in build tools)")],
    ),
    ("dynamic-require", "require(x); require('y'); require(`z`)", "a.js", [("high", 0.85, "Dynamic require() with non-literal argument — module path determined at runtime")]),
    ("dynamic-require", "require.resolve(x)", "a.js", [("high", 0.8, "Dynamic require.resolve() with computed path")]),
    ("dynamic-require", "import(x); import('y')", "a.js", [("high", 0.85, "Dynamic import() with computed module specifier"), ("high", 0.85, "Dynamic import() with non-literal argument — module path determined at runtime")]),
    (
        "dynamic-require", "require(path.join(a, b))", "a.js",
        [("high", 0.85, "Dynamic require() with non-literal argument — module path determined at runtime"), ("medium", 0.6, "require() with computed path (path.join/resolve or __dirname)")],
    ),
    # what needs a tree: calls within templates, wrapped literals, parents of literals, callees over several lines
    ("network-access", "x = `a ${`b ${fetch('https://evil.io/')}`}`", "a.js", [("high", 0.9, "Makes HTTP request via fetch()")]),
    ("network-access", "x = `fetch(u)`; y = '${fetch(u)}'; // fetch(u)", "a.js", []),
    ("network-access", "const post = async (u: string): Promise<void> => { await http\n .get(u) }", "a.ts", [("medium", 0.8, "Network call: http.get()")]),
    ("network-access", "axios.get<Answer<string>>(u)", "a.ts", [("medium", 0.8, "Network call: axios.get()")]),
    ("network-access", "class A { fetch(u) { } get http() { return 1 } } function got(u) { }", "a.ts", []),
    ("network-access", "new https.Server(f); new Server(f)", "a.js", [("high", 0.9, "Opens WebSocket connection")]),
    ("dynamic-require", "require(('x')); require('x' as const); require('y'!); require(<string>'z'); require(('x') satisfies string)", "a.ts", []),
    ("dynamic-require", "require(x as string)", "a.ts", [("high", 0.85, "Dynamic require() with non-literal argument — module path determined at runtime")]),
    ("dynamic-require", "require(`a${x}`)", "a.js", [("high", 0.85, "Dynamic require() with non-literal argument — module path determined at runtime")]),
    ("dynamic-require", "require(); require.resolve(`y`); import.meta.url; load.require(x)", "a.js", []),
    ("dynamic-require", "require(__dirname + '/x')", "a.js", [("high", 0.85, "Dynamic require() with non-literal argument — module path determined at runtime"), ("medium", 0.6, "require() with computed path (path.join/resolve or __dirname)")]),
    ("filesystem-access", "f(a + '~/.npmrc'); f(c ? '~/.npmrc' : d); f(() => '~/.npmrc'); '~/.npmrc'.concat(x)", "a.js", []),
    ("filesystem-access", "f('~/.npmrc' + b + c)", "a.js", [("high", 0.8, "References sensitive path: ~/.npmrc")]),
    ("filesystem-access", "new F('~/.npmrc')", "a.js", [("high", 0.8, "References sensitive path: ~/.npmrc")]),
    ("filesystem-access", "f({ p: '~/.npmrc' })", "a.js", [("high", 0.8, "References sensitive path: ~/.npmrc")]),
    ("filesystem-access", "x = `~/.npmrc`", "a.js", []),
    ("filesystem-access", "fs.unlinkSync(`~/.npmrc`)", "a.js", [("critical", 0.95, "Writes/deletes to sensitive path: ~/.npmrc")]),
    ("filesystem-access", "promises.stat(p); import('fs').then(m => m.readdirSync(p))", "a.js", [("medium", 0.85, "Filesystem read operation: stat()"), ("medium", 0.85, "Filesystem read operation: readdirSync()")]),
    ("process-spawn", "cp.exec(a - b); fork(c)", "a.js", [("critical", 0.85, "Spawns child process: fork()")]),
    ("process-spawn", "execFile(f, [`a${b}`])", "a.js", [("critical", 0.85, "Spawns child process: execFile()")]),
    ("process-spawn", "spawnSync((x, y), a * (b + c))", "a.js", [("critical", 0.95, "Command injection risk: spawnSync() called with dynamic string argument")]),
    ("process-spawn", "import 'vm'; new Function; x.eval(y)", "a.js", [("critical", 1.0, 'Imports VM module "vm"'), ("critical", 0.95, "Creates function from string via Function constructor")]),
    ("process-spawn", "import 'node:worker_threads'", "a.js", [("high", 0.9, "Imports worker_threads — can execute code in isolated threads")]),
    ("env-access", "a = process.env; b = f(process.env); process.env.A.B", "a.js", [("info", 0.95, "Reads environment variable: A")]),
    ("env-access", "let { A, B: { c }, D = f(1, 2), ...rest } = process.env", "a.js", [("medium", 0.95, "Destructures process.env: A, {c}, D, rest")]),
    ("env-access", "Object.values(process.env); f(...process.env); Object.keys(env)", "a.js", [("high", 0.95, "Enumerates all environment variables via Object.values(process.env)")]),
    ("env-access", "process.env[`HOME`]; process.env?.HOME", "a.js", [("high", 0.9, "Dynamic environment variable access with computed key"), ("info", 0.95, "Reads environment variable: HOME")]),
    ("crypto-usage", "import c from 'crypto'; c.generateKeyPairSync(x); x.randomBytes(2)", "a.js", [("low", 0.8, 'Imports crypto module "crypto"'), ("low", 0.6, "Crypto operation: generateKeyPairSync()"), ("low", 0.6, "Crypto operation: randomBytes()")]),
    ("crypto-usage", "import c from 'crypto'; import h from 'http'; c.scrypt(x); y.toString('base64')", "a.js", [("high", 0.8, 'Imports crypto module "crypto" (co-occurs with network access)'), ("high", 0.85, "Crypto operation scrypt() near network code (potential exfiltration prep)"), ("high", 0.8, "Base64 encoding near network code (potential data exfiltration)")]),
    ("crypto-usage", "window.atob(x); Buffer.alloc(2, 'base64'); x.toString(`base64`)", "a.js", []),
    ("obfuscation", "function f(window, [global], { process }) { window['a']; }", "a.js", []),
    ("obfuscation", "globalThis[`x`]", "a.js", [("critical", 0.85, "Dynamic bracket notation access on globalThis (obfuscation technique)")]),
    ("obfuscation", "eval(a - b)", "a.js", [("critical", 0.95, "eval() with string concatenation/template — obfuscated code execution")]),
    ("obfuscation", "eval(('a' + b)); x.eval('a' + b); eval('a')", "a.js", []),
    ("install-scripts", "axios.post(u); spawnSync(c)", "lib/preinstall/x.js", [("critical", 0.9, "Download-and-execute pattern: axios.post() with subsequent code execution in install script")]),
    ("install-scripts", "fetch(u); run(c)", "postinstall.js", []),
    ("install-scripts", "stream.pipeline(http.get(u), spawn(c))", "a.js", [("critical", 0.9, "Pipes downloaded content to execution or file write"), ("low", 0.3, "File has both network fetch and code execution (common in tools/servers)")]),
    ("install-scripts", "p.catch(x => eval(x)); p.finally(eval)", "a.js", [("critical", 0.95, "Promise chain passes downloaded content directly to eval/Function")]),
    ("install-scripts", "cp.exec(`wget ${u}`)", "a.js", [("critical", 0.95, "Shell execution with download command: exec() contains URL or curl/wget")]),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(str(k), path, code, False) for k, (_, code, path, _) in enumerate(CASES)], FILES)
    rows = code_facts.detect(code_facts.facts(files).cache()).collect()
    return [[r for r in rows if r.pkg == str(k) and r.category == case[0]] for k, case in enumerate(CASES)]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rules(found, k):
    assert sorted((r.severity, round(r.confidence, 4), r.description) for r in found[k]) == sorted(CASES[k][3])


def test_places_and_snippets(spark):
    code = "const a = 1;\n  new WebSocket('ws://x');\nfs.readFile('/etc/passwd', cb);\nconst { A,\n B } = process.env;\n"
    rows = code_facts.detect(code_facts.facts(spark.createDataFrame([("p", "a.js", code, True)], FILES))).collect()
    at = {r.category: (r.line, r.column, r.snippet, round(r.confidence, 3)) for r in rows}
    assert at["network-access"] == (2, 3, "new WebSocket('ws://x')", 0.27)
    assert at["filesystem-access"] == (3, 1, "fs.readFile('/etc/passwd', cb)", 0.285)
    assert at["env-access"][:3] == (4, 7, "{ A,\n B } = process.env")


def test_files_that_cannot_be_scanned_are_counted(spark, monkeypatch):
    files = spark.createDataFrame([("p", "a.js", "x", False), ("p", "b.js", None, False)], FILES)
    facts = code_facts.facts(files)
    assert [(r.failed, len(r.calls)) for r in facts.collect()] == [(False, 0)] * 2
    assert code_facts.unscanned(facts).count() == 0


def test_functions_scopes_and_categories(spark):
    code = "function a<T>(x: T, { y }, ...z): void { fs.readFile(x); const b = async q => { cp.exec(q); exec(q) }; fetch(u) }\nclass C { m(p) { return function n(r) { eval(r) } } get g() { rm(1) } }\nnew Worker(w); other(1)"
    facts = code_facts.facts(spark.createDataFrame([("p", "a.ts", code, False)], FILES)).cache()
    calls = [(r.expression, r.category, r.scope) for r in code_facts.file_calls(facts).orderBy("pos").collect()]
    assert calls == [("fs.readFile", "filesystem-access", "a"), ("cp.exec", None, "b"), ("exec", "process-spawn", "b"), ("fetch", "network-access", "a"), ("eval", "process-spawn", "m"), ("rm", "filesystem-access", ""), ("other", None, "")]
    functions = {(r.name, tuple(r.parameters), r.line, r.column, r.first_line, r.last_line) for r in code_facts.file_functions(facts).collect()}
    assert functions == {("a", ("x", "{y}", "z"), 1, 1, 1, 1), ("b", ("q",), 1, 64, 1, 1), ("m", ("p",), 2, 11, 2, 2)}
    assert {r.module: r.names for r in code_facts.facts(spark.createDataFrame([("p", "a.ts", "import d, { x as y, type Z } from 'm'; import * as n from 'n'", False)], FILES)).first().imports} == {"m": ["x", "Z"], "n": []}


def test_reading_takes_time_in_proportion():
    import time

    from thornwick.functions.lexer import scan

    line = "const f{k} = (a, b) => fetch(`https://x.io/${{a}}`, {{b: [1, 'two', b + 'c']}}).then(r => r.json()).catch(e => {{ log(e, {k}) }});\n"
    took = []
    for n in (500, 4000):
        code, best = "".join(line.format(k=k) for k in range(n)), 1e9
        for _ in range(2):
            t = time.perf_counter()
            assert len(scan(code).calls) == 5 * n
            best = min(best, time.perf_counter() - t)
        took.append(best)
    assert took[1] < 8 * 2.5 * took[0]


@pytest.mark.parametrize("part", ["(", "f(", "[", "{", "a?b:", "`${", "a=>", "x+", ".g()", "if(a){", "<", "x<", "a:(b", "async(", "(a):", "class A{m(){", "case", "let{", "import{", "@", "new ", "...", "=>", "}", "`", "'", "/", "\\"])
def test_any_text_is_read(part):
    from thornwick.functions.lexer import scan

    scan(part * 400)
    scan("x" + part * 100 + ")" * 50 + "; fetch(u)")
