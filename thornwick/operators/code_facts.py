"""Facts of code files as tables, and the detectors that read them.

A file is scanned once, in Arrow batches; its facts are arrays of one row, from which each detector explodes what it needs.
A file that can't be scanned has no facts, is marked `failed`, and does not stop the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thornwick.functions import tables as t
from thornwick.functions.text import java

FACTS = (
    "pkg string, file string, is_fixture boolean, failed boolean, guarded boolean, imports array<struct<module:string,names:array<string>,default:string,required:boolean,line:int,column:int,text:string>>,"
    " calls array<struct<expression:string,arguments:array<string>,kinds:array<string>,is_new:boolean,marks:array<string>,hosts:array<string>,line:int,column:int,text:string,scope:string>>,"
    " env array<struct<variables:array<string>,form:string,line:int,column:int,text:string>>,"
    " functions array<struct<name:string,parameters:array<string>,line:int,column:int,first_line:int,last_line:int>>, literals array<struct<kind:string,text:string,parent:string,grandparent:string,line:int,column:int>>,"
    " elements array<struct<object:string,key:string,kind:string,line:int,column:int,text:string>>, declared array<string>, long_lines array<struct<line:int,column:int,length:int,text:string>>"
)

# Words of guards against requests, and the forms of long lines that are text.
GUARDS = r"(?i)\b(validate|isPrivate|isLocal|blockList|blocklist|allowList|allowlist|denyList|denylist|ssrf|sanitize|safelist|safeList|isAllowed|isBlocked|checkUrl|verifyUrl|filterUrl)\b"
LONG_LINE, LONG_PUNCTUATION = 800, 20
PROSE_LINES = (
    r"""\s*(?:const|let|var|export\s+(?:const|let|var))\s+\w+\s*(?::\s*[\w<>,|\s]+\s*)?=\s*['"`]""", r"""\s*(?:['"][\w$-]+['"]|\w+)\s*:\s*['"`]""", r"""\s*return\s+['"`]""", r"""\s*\[?\s*['"`]""",
)
_GUARD, _PROSE = re.compile(GUARDS), re.compile("|".join(f"(?:{x})" for x in PROSE_LINES))
_STRING = re.compile(r"""'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)""", re.S)
_PUNCTUATION = re.compile(r"[;{}()=+\-*/&|<>!?:,]")


def packed_lines(code: str) -> list[dict]:
    """Long lines that are code rather than text: mostly outside of strings, and dense with punctuation."""
    from thornwick.functions.lexer import cut

    found = []
    for k, line in enumerate(code.split("\n"), 1):
        bare = line.strip()
        if len(line) <= LONG_LINE or bare.startswith(("//", "/*", "*", "import ", "require(", "export ")) or _PROSE.match(bare):
            continue
        if len(_STRING.sub("", line)) >= 0.3 * len(line) and len(_PUNCTUATION.findall(line)) >= LONG_PUNCTUATION:
            found.append({"line": k, "column": 1, "length": len(line), "text": cut(line)})
    return found


def facts(files: DataFrame) -> DataFrame:
    """files: pkg, path, content, is_fixture."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        from thornwick.functions.lexer import Facts, scan

        def of(r: dict) -> dict:
            code, failed = r["content"] or "", False
            try:
                found = scan(code)
            except (IndexError, ValueError, RecursionError, AttributeError):
                found, failed = Facts(), True
            starts = [0, *(i + 1 for i, c in enumerate(code) if c == "\n")]

            def at(offset: int) -> dict[str, int]:
                line = bisect_right(starts, offset)
                return {"line": line, "column": offset - starts[line - 1] + 1}

            return {
                "pkg": r["pkg"],
                "file": r["path"],
                "is_fixture": r["is_fixture"],
                "failed": failed,
                "guarded": bool(_GUARD.search(code)),
                "imports": [{"module": m, "names": n, "default": d, "required": q, "text": x} | at(o) for m, n, d, q, o, x in found.imports],
                "calls": [{"expression": c.expression, "arguments": c.arguments, "kinds": c.kinds, "is_new": c.is_new, "marks": c.marks, "hosts": c.hosts, "text": c.text, "scope": c.scope} | at(c.at) for c in found.calls],
                "env": [{"variables": v, "form": f, "text": x} | at(o) for v, f, o, x in found.env],
                "functions": [{"name": n, "parameters": p, "first_line": at(s)["line"], "last_line": at(e - 1)["line"]} | at(o) for n, p, o, s, e in found.functions],
                "literals": [{"kind": k, "text": x, "parent": p, "grandparent": g} | at(o) for k, x, p, g, o in found.literals],
                "elements": [{"object": b, "key": e, "kind": k, "text": x} | at(o) for b, e, k, o, x in found.elements],
                "declared": sorted(found.declared),
                "long_lines": packed_lines(code),
            }

        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # what is held and sent at once
                yield pa.RecordBatch.from_pylist([of(r) for r in batch.slice(i, 64).to_pylist()], schema=schema)

    return files.select("pkg", "path", "content", "is_fixture").mapInArrow(run, FACTS)


def unscanned(found: DataFrame) -> DataFrame:
    """How many files of each package could not be scanned."""
    return found.filter("failed").groupBy("pkg").agg(F.count(F.lit(1)).alias("files"))


def _imports(modules: tuple[str, ...]) -> Column:
    return F.exists("imports", lambda i: i["module"].isin(*modules))


def _found(df: DataFrame, row: str, category: str, severity: Column | str, confidence: Column | float, description: Column | str, snippet: Column | str | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    sure = lit(confidence).cast("double")
    return df.select(
        "pkg", F.lit(category).alias("category"), lit(severity).alias("severity"), "file", F.col(f"{row}.line").alias("line"), F.col(f"{row}.column").alias("column"), lit(description).alias("description"),
        (F.col(f"{row}.text") if snippet is None else lit(snippet)).alias("snippet"), F.when(F.col("is_fixture"), sure * t.FIXTURE_FACTOR).otherwise(sure).alias("confidence"), F.col("is_fixture").alias("is_test_fixture"),
    )


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _each(df: DataFrame, name: str) -> DataFrame:
    return df.select("*", F.explode(name).alias("x"))


def _calls(df: DataFrame, new: bool = False) -> DataFrame:
    return _each(df, "calls").filter(F.col("x.is_new") == new)


def _said(*parts: str | Column) -> Column:
    """Texts and columns (x.…) joined."""
    return F.concat(*[F.col(p) if isinstance(p, str) and p.startswith("x.") else F.lit(p) if isinstance(p, str) else p for p in parts])


def _by_import(modules: tuple[str, ...], what: str, df: DataFrame, category: str, severity: Column | str = "medium", confidence: float = 1.0, said: Column | str | None = None) -> DataFrame:
    verb = F.when(F.col("x.required"), "Requires ").otherwise("Imports ")
    rows = _each(df, "imports").filter(F.col("x.module").isin(*modules))
    return _found(rows, "x", category, severity, confidence, F.concat(verb, F.lit(what)) if said else _said(verb, f'{what} "', "x.module", '"'))


def _last(expression: Column) -> Column:
    return F.element_at(F.split(expression, r"\."), -1)


def _touches(text: Column) -> Column:
    """Whether a text holds a sensitive path (of one in the home directory, what follows it)."""
    slashed = F.replace(text, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for p in t.SENSITIVE_PATHS:
        out = out | F.contains(slashed, F.lit(p.replace("~/", "")))
    return out


def _short(text: Column, n: int = 60) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


# Operations of the file system.
FS_WRITES = (
    "writeFile", "writeFileSync", "appendFile", "appendFileSync", "unlink", "unlinkSync", "rmdir", "rmdirSync", "rm", "rmSync", "rename", "renameSync", "copyFile", "copyFileSync", "mkdir", "mkdirSync",
    "chmod", "chmodSync", "chown", "chownSync", "truncate", "truncateSync", "createWriteStream",
)
FS_READS = (
    "readFile", "readFileSync", "readdir", "readdirSync", "stat", "statSync", "lstat", "lstatSync", "access", "accessSync", "exists", "existsSync", "realpath", "realpathSync", "createReadStream",
    "open", "openSync", "opendir", "opendirSync", "watch", "watchFile",
)
# Calls that send, hosts that are not outside.
NET_BARE = ("fetch", "request", "get", "post", "put", "patch", "delete")
NET_CALLS = (
    "http.request", "http.get", "https.request", "https.get", "net.createConnection", "net.connect", "axios.get", "axios.post", "axios.put", "axios.patch", "axios.delete", "axios.request",
    "got.get", "got.post", "got.put", "got.patch", "got.delete",
)
SAFE_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "example.com", "schema.org", "json-schema.org", "w3.org", "github.com", "npmjs.com", "nodejs.org")
# Calls of processes, virtual machines, cryptography.
SPAWN_CALLS = ("exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync", "fork")
VM_CALLS = ("runInNewContext", "runInThisContext", "runInContext", "createContext", "compileFunction")
WORKER_MODULES = ("worker_threads", "node:worker_threads")
CRYPTO_CALLS = (
    "createCipher", "createCipheriv", "createDecipher", "createDecipheriv", "createHash", "createHmac", "createSign", "createVerify", "publicEncrypt", "privateDecrypt", "generateKeyPair", "generateKeyPairSync",
    "randomBytes", "scrypt", "scryptSync", "pbkdf2", "pbkdf2Sync",
)
# Objects whose bracket access hides a name; calls that download, execute, pipe.
GLOBALS = ("process", "global", "globalThis", "window", "require", "module", "exports", "constructor")
DOWNLOADS = ("fetch", "http.get", "https.get", "http.request", "https.request", "axios.get", "axios.post", "got", "got.get", "request", "request.get")
EXECUTES = ("eval", "exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync")
PIPES = ("pipe", "pipeline")
INSTALL_FILES = ("postinstall", "preinstall", "install.", "scripts/setup", "scripts/prepare")


def filesystem(df: DataFrame) -> DataFrame:
    c = "filesystem-access"
    calls = _calls(df)
    expression, name = F.col("x.expression"), _last(F.col("x.expression"))
    before = F.coalesce(F.try_element_at(F.split(expression, r"\."), F.lit(-2)), F.lit(""))
    known = _imports(t.MODULES["filesystem"]) | expression.rlike(r"^(?:fs|fsp|fsPromises|fse|gracefulFs)\b") | before.rlike(r"^promises\b")
    some = calls.filter(name.isin(*FS_WRITES, *FS_READS) & (known | F.contains(expression, F.lit("."))))
    texts = F.transform(F.arrays_zip("x.arguments", "x.kinds"), lambda a: F.struct(a["kinds"].alias("kind"), F.when(a["kinds"].isin("string", "plain"), F.regexp_replace(a["arguments"], r"^.|.\z", "")).otherwise(_short(a["arguments"])).alias("shown"), (a["kinds"].isin("string", "plain", "template") & _touches(a["arguments"])).alias("touches")))
    some = some.withColumn("path", F.try_element_at(F.filter(texts, lambda a: a["touches"]), F.lit(1))["shown"])
    write, touched = name.isin(*FS_WRITES), F.col("path").isNotNull()
    severity = F.when(touched & write, "critical").when(touched, "high").otherwise("medium")
    said = F.when(touched & write, _said("Writes/deletes to sensitive path: ", F.col("path"))).when(touched, _said("Reads from sensitive path: ", F.col("path"))).when(write, _said("Filesystem write/delete operation: ", name, "()")).otherwise(_said("Filesystem read operation: ", name, "()"))
    stray = _each(df, "literals").filter((F.col("x.kind") == "string") & (F.col("x.parent") != "call") & (F.col("x.grandparent") != "call") & _touches(F.col("x.text")))
    return _union(
        _by_import(t.MODULES["filesystem"], "filesystem module", df, c),
        _found(some, "x", c, severity, F.when(touched, 0.95).otherwise(0.85), said),
        _found(stray, "x", c, "high", 0.8, _said("References sensitive path: ", _short(F.col("x.text"))), _short(F.col("x.text"), 120)),
    )


def _host(x: Column) -> Column:
    return F.regexp_replace(x, r"^\d+:", "")


def _safe(host: Column) -> Column:
    return F.lower(host).isin(*SAFE_HOSTS) | host.rlike(r"^127\.\d+\.\d+\.\d+\z") | (host == "::1")


def local_only(arguments: Column) -> Column:
    """Whether every host that the arguments show is this machine, and some is shown."""
    shows = lambda a: a.rlike("https?://") | a.rlike(java(t.HOST_PROPERTY))
    return F.exists(arguments, shows) & F.forall(arguments, lambda a: ~shows(a) | a.rlike(java(t.LOCAL_HOST)))


def network(df: DataFrame) -> DataFrame:
    c = "network-access"
    calls, expression = _calls(df), F.col("x.expression")
    local, external = F.exists("x.hosts", lambda h: _safe(_host(h))), F.exists("x.hosts", lambda h: ~_safe(_host(h)))
    client = calls.filter(~expression.isin(*t.SERVER_CALLS) & (expression.isin(*NET_CALLS) | (expression == "fetch") | expression.isin(*NET_BARE) & _imports(t.MODULES["network"])))
    said = F.when(expression == "fetch", "Makes HTTP request via fetch()").otherwise(_said("Network call: ", "x.expression", "()"))
    beside = F.when(local & ~external, " (targets localhost)").when(_imports(t.MODULES["filesystem"]) & ~local, " (co-occurs with filesystem access)").otherwise("")
    severity = F.when(local & ~external, "low").when(external, "high").otherwise("medium")
    sockets = _calls(df, True).filter(expression.isin("WebSocket", "WebSocket.Server", "Server"))
    first = F.try_element_at(F.filter("x.hosts", lambda h: h.startswith("0:")), F.lit(1))
    urls = _calls(df, True).filter((expression == "URL") & F.exists("x.marks", lambda m: m.rlike("^0:https?://"))).withColumn("host", _host(first)).filter(~F.col("host").isin(*SAFE_HOSTS))
    return _union(
        _by_import(t.MODULES["network"], "network module", df, c),
        _found(calls.filter(expression.isin(*t.SERVER_CALLS)), "x", c, "low", 1.0, _said("Creates local server: ", "x.expression", "()")),
        _found(client, "x", c, severity, F.when(external, 0.9).otherwise(0.8), F.concat(said, beside)),
        _found(sockets, "x", c, "high", 0.9, "Opens WebSocket connection"),
        _found(urls, "x", c, "medium", 0.7, _said("Constructs URL to external host: ", F.col("host"))),
    )


def secret(name: Column) -> Column:
    upper = F.upper(name)
    has = lambda w: F.contains(upper, F.lit(w))
    return name.isin(*t.SENSITIVE_VARIABLES) | has("SECRET") | has("PASSWORD") | has("PRIVATE_KEY") | has("TOKEN") & ~has("TOKENIZE") | has("API_KEY")


def environment(df: DataFrame) -> DataFrame:
    rows = _each(df, "env")
    form, names = F.col("x.form"), F.col("x.variables")
    one, bad = F.get(names, F.lit(0)), F.filter(names, secret)
    severity = F.when(F.size(bad) > 0, "low").when(form.isin("property", "literal"), "info").when((form == "destructured") & (F.size(names) <= 5), "medium").otherwise("high")
    confidence = F.when(form.isin("computed", "alias", "spread"), 0.9).otherwise(0.95)
    listed = lambda x: F.array_join(x, ", ")
    said = (
        F.when(form.isin("property", "literal") & (F.size(bad) > 0), _said("Reads sensitive environment variable from process.env: ", one))
        .when(form == "property", _said("Reads environment variable: ", one))
        .when(form == "literal", _said("Reads environment variable via bracket notation: ", one))
        .when(form == "computed", "Dynamic environment variable access with computed key")
        .when((form == "destructured") & (F.size(bad) > 0), _said("Destructures sensitive vars from process.env: ", listed(bad)))
        .when((form == "destructured") & (F.size(names) > 5), _said("Bulk destructuring of process.env (", F.size(names).cast("string"), " variables)"))
        .when(form == "destructured", _said("Destructures process.env: ", listed(names)))
        .when(form == "alias", "Assigns entire process.env to a variable (bulk access)")
        .when(form == "spread", "Spreads entire process.env (bulk access)")
        .otherwise(_said("Enumerates all environment variables via ", "x.form", "(process.env)"))
    )
    return _found(rows, "x", "env-access", severity, confidence, said)


def process_spawn(df: DataFrame) -> DataFrame:
    c = "process-spawn"
    calls, expression = _calls(df), F.col("x.expression")
    name = _last(expression)
    built = F.exists("x.kinds", lambda k: k.isin("template", "concat"))
    spawn = calls.filter(name.isin(*SPAWN_CALLS) & ((name != "exec") | ~F.contains(expression, F.lit(".")) | _imports(t.MODULES["process"])))
    said = F.when(built, _said("Command injection risk: ", name, "() called with dynamic string argument")).otherwise(_said("Spawns child process: ", name, "()"))
    return _union(
        _by_import(t.MODULES["process"], "child_process module", df, c, "critical"),
        _by_import(t.MODULES["vm"], "VM module", df, c, "critical"),
        _by_import(WORKER_MODULES, "worker_threads — can execute code in isolated threads", df, c, "high", 0.9, "whole"),
        _found(spawn, "x", c, "critical", F.when(built, 0.95).otherwise(0.85), said),
        _found(calls.filter(name.isin(*VM_CALLS)), "x", c, "critical", 0.95, _said("Executes code in VM context: ", "x.expression", "()")),
        _found(calls.filter(expression == "eval"), "x", c, "critical", 0.9, F.when(built, "Uses eval() with dynamic string construction").otherwise("Uses eval() for code execution")),
        _found(_calls(df, True).filter(expression == "Function"), "x", c, "critical", 0.95, "Creates function from string via Function constructor"),
    )


def crypto(df: DataFrame) -> DataFrame:
    c = "crypto-usage"
    near = _imports(t.MODULES["network"])
    severity = F.when(near, "high").otherwise("low")
    calls, expression = _calls(df), F.col("x.expression")
    name = _last(expression)
    base64 = lambda i: F.coalesce(F.get("x.arguments", F.lit(i)).isin("'base64'", '"base64"'), F.lit(False))
    sure = lambda a, b: F.when(near, a).otherwise(b)
    imports = _each(df, "imports").filter(F.col("x.module").isin(*t.MODULES["crypto"]) & ~F.col("x.required"))
    beside = F.when(near, " (co-occurs with network access)").otherwise("")
    return _union(
        _found(imports, "x", c, severity, 0.8, _said('Imports crypto module "', "x.module", '"', beside)),
        _found(calls.filter(name.isin(*CRYPTO_CALLS) & _imports(t.MODULES["crypto"])), "x", c, severity, sure(0.85, 0.6), F.when(near, _said("Crypto operation ", name, "() near network code (potential exfiltration prep)")).otherwise(_said("Crypto operation: ", name, "()"))),
        _found(calls.filter(expression.endswith(".toString") & base64(0)), "x", c, severity, sure(0.8, 0.5), F.when(near, "Base64 encoding near network code (potential data exfiltration)").otherwise("Base64 encoding")),
        _found(calls.filter((expression == "Buffer.from") & base64(1)), "x", c, severity, 0.7, "Base64 decoding via Buffer.from"),
        _found(calls.filter(expression.isin("btoa", "atob")), "x", c, severity, sure(0.75, 0.5), F.when(near, _said("x.expression", "() near network code (potential data encoding for exfiltration)")).otherwise(_said("x.expression", "() encoding/decoding"))),
    )


def obfuscation(df: DataFrame) -> DataFrame:
    c = "obfuscation"
    from_codes = lambda x: (x["expression"] == "String.fromCharCode") & ~x["is_new"]
    chars = df.withColumn("coded", F.filter("calls", from_codes)).withColumn("n", F.size("coded"))
    few = _each(chars.filter("n <= 3"), "coded")
    many = chars.filter("n > 3").withColumn("x", F.element_at("coded", 1))
    access = _each(df, "elements").filter(F.col("x.object").isin(*GLOBALS) & ~F.array_contains("declared", F.col("x.object")))
    named = F.col("x.kind") == "string"
    literals = _each(df, "literals").withColumns({"hexes": F.regexp_count("x.text", F.lit(r"\\x[0-9A-Fa-f]{2}")), "codes": F.regexp_count("x.text", F.lit(r"\\u[0-9A-Fa-f]{4}")), "plain": F.regexp_count("x.text", F.lit(r"\\u00(?:[2-6][0-9A-Fa-f]|7[0-9A-Ea-e])"))})
    count = lambda x: F.col(x).cast("string")
    text = _short(F.col("x.text"), 120)
    string = F.col("x.kind") == "string"
    evaluated = _calls(df).filter((F.col("x.expression") == "eval") & F.coalesce(F.get("x.kinds", F.lit(0)).isin("concat", "binary", "template"), F.lit(False)))
    return _union(
        _found(few, "x", c, "high", 0.6, "Uses String.fromCharCode (potential string obfuscation)"),
        _found(many, "x", c, "critical", 0.9, _said("Heavy String.fromCharCode usage (", count("n"), " calls) — likely obfuscated strings")),
        _found(access, "x", c, "critical", F.when(named, 0.9).otherwise(0.85), F.when(named, _said("Bracket notation access: ", "x.object", "['", "x.key", "'] (obfuscation technique to evade static analysis)")).otherwise(_said("Dynamic bracket notation access on ", "x.object", " (obfuscation technique)"))),
        _found(literals.filter(string & (F.col("hexes") > 3)), "x", c, "critical", 0.85, _said("Hex-escaped string with ", count("hexes"), " escape sequences (obfuscated content)"), text),
        _found(literals.filter((F.col("x.kind") == "plain") & (F.col("hexes") > 3)), "x", c, "critical", 0.85, _said("Hex-escaped template literal with ", count("hexes"), " escape sequences"), text),
        _found(_each(df, "long_lines"), "x", c, "critical", 0.75, _said("Very long single-line expression (", F.col("x.length").cast("string"), " chars) — possibly minified or obfuscated code")),
        _found(evaluated, "x", c, "critical", 0.95, "eval() with string concatenation/template — obfuscated code execution"),
        _found(literals.filter(string & (F.col("codes") > 3) & (F.col("plain") > 3)), "x", c, "critical", 0.85, _said("Unicode-escaped string with ", count("plain"), " ASCII-identifier escapes (string obfuscation)"), text),
    )


def install_scripts(df: DataFrame) -> DataFrame:
    c = "install-scripts"
    called = lambda x, names: ~x["is_new"] & (x["expression"].isin(*names) | _last(x["expression"]).isin(*names))
    got = F.filter("calls", lambda x: called(x, DOWNLOADS))
    runs = F.exists("calls", lambda x: called(x, EXECUTES))
    stored = F.exists("calls", lambda x: F.contains(x["expression"], F.lit("createWriteStream")) & ~x["is_new"])
    script = F.lit(False)
    for part in INSTALL_FILES:
        script = script | F.contains(F.lower("file"), F.lit(part))
    marked = lambda *marks: F.exists("x.marks", lambda m: F.regexp_replace(m, r"^\d+:", "").isin(*marks))
    both = df.filter((F.size(got) > 0) & runs)
    one = both.filter(script | ~F.col("guarded")).withColumn("x", F.element_at(got, 1))
    top = F.struct(F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("").alias("text"))
    calls, name = _calls(df), _last(F.col("x.expression"))
    passed = F.exists("x.arguments", lambda a: a == "eval") | marked("eval(", "Function(")
    executes = name.isin(*EXECUTES) | F.col("x.expression").isin(*EXECUTES)
    return _union(
        _found(one, "x", c, F.when(script, "critical").otherwise("low"), F.when(script, 0.9).otherwise(0.3), F.when(script, _said("Download-and-execute pattern: ", "x.expression", "() with subsequent code execution in install script")).otherwise("File has both network fetch and code execution (common in tools/servers)")),
        _found(calls.filter((F.size(got) > 0) & name.isin(*PIPES) & marked("exec", "spawn", "createWriteStream")), "x", c, "critical", 0.9, "Pipes downloaded content to execution or file write"),
        _found(calls.filter(name.isin("then", "catch") & passed), "x", c, "critical", 0.95, "Promise chain passes downloaded content directly to eval/Function"),
        _found(calls.filter(executes & marked("curl ", "wget ", "http://", "https://")), "x", c, "critical", 0.95, _said("Shell execution with download command: ", name, "() contains URL or curl/wget")),
        _found(both.filter(stored).withColumn("x", top), "x", c, F.when(script, "critical").otherwise("medium"), F.when(script, 0.85).otherwise(0.3), F.when(script, "Install script downloads content to disk and executes it (download-write-execute pattern)").otherwise("File has download, write, and execute calls (common in build tools)")),
    )


def dynamic_require(df: DataFrame) -> DataFrame:
    c = "dynamic-require"
    calls = _calls(df).filter(F.size("x.arguments") > 0)
    expression, computed = F.col("x.expression"), ~F.get("x.kinds", F.lit(0)).isin("string", "plain", "literal")
    pathed = F.exists("x.marks", lambda m: m.isin("0:path.join", "0:path.resolve", "0:__dirname", "0:__filename"))
    rows = lambda name: calls.filter((expression == name) & computed)
    return _union(
        _found(rows("require"), "x", c, "high", 0.85, "Dynamic require() with non-literal argument — module path determined at runtime"),
        _found(rows("require.resolve"), "x", c, "high", 0.8, "Dynamic require.resolve() with computed path"),
        _found(rows("import"), "x", c, "high", 0.85, "Dynamic import() with non-literal argument — module path determined at runtime"),
        _found(rows("import"), "x", c, "high", 0.85, "Dynamic import() with computed module specifier"),
        _found(calls.filter((expression == "require") & pathed), "x", c, "medium", 0.6, "require() with computed path (path.join/resolve or __dirname)"),
    )


DETECTORS = {"filesystem-access": filesystem, "network-access": network, "env-access": environment, "process-spawn": process_spawn, "crypto-usage": crypto, "obfuscation": obfuscation, "install-scripts": install_scripts, "dynamic-require": dynamic_require}


def detect(found: DataFrame, only: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    rows = None
    for k, name in enumerate(only):
        part = DETECTORS[name](found).withColumn("ord", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def taint_sources(found: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for e, k, s in t.TAINT_SOURCES for x in (e, f"{k}|{s}")])
    rows = found.select("pkg", "file", F.explode("calls").alias("x")).withColumn("k", F.try_element_at(kinds, F.col("x.expression"))).filter("k is not null")
    touched = F.exists("x.arguments", lambda a: _touches(a))
    kind = F.substring_index("k", "|", 1)
    said = F.when(touched, F.concat(kind, F.lit("() reading sensitive path: "), F.coalesce(F.get("x.arguments", F.lit(0)), F.lit("")))).otherwise(F.concat(kind, F.lit("() call")))
    return rows.select("pkg", "file", "x.line", "x.column", kind.alias("type"), F.when(touched, "critical").otherwise(F.substring_index("k", "|", -1)).alias("severity"), said.alias("description"))


def taint_sinks(found: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for e, k, s in t.TAINT_SINKS for x in (e, f"{k}|{s}")])
    rows = found.select("pkg", "file", _imports(t.MODULES["network"]).alias("networked"), F.explode("calls").alias("x"))
    rows = rows.filter(~F.col("x.expression").isin(*t.SERVER_CALLS) & ~local_only(F.col("x.arguments"))).withColumn("k", F.try_element_at(kinds, F.col("x.expression")))
    extra = F.col("k").isNull() & F.col("networked") & F.contains("x.expression", F.lit("request"))
    rows = rows.filter(F.col("k").isNotNull() | extra)
    known = rows.filter("k is not null").select("pkg", "file", "x.line", "x.column", F.substring_index("k", "|", 1).alias("type"), F.substring_index("k", "|", -1).alias("severity"))
    more = rows.filter("k is null").select("pkg", "file", "x.line", "x.column", F.col("x.expression").alias("type"), F.lit("high").alias("severity"))
    more = more.join(known.select("pkg", "file", "line").distinct(), ["pkg", "file", "line"], "left_anti")
    return known.unionByName(more).withColumn("description", F.concat("type", F.lit("() call")))


def environment_accesses(found: DataFrame) -> DataFrame:
    bulk = ~F.col("x.form").isin("property", "literal", "computed", "destructured")
    return found.select("pkg", "file", F.explode("env").alias("x")).select("pkg", "file", "x.line", "x.column", F.explode_outer("x.variables").alias("variable"), bulk.alias("is_bulk")).fillna({"variable": ""})


def file_imports(found: DataFrame) -> DataFrame:
    return found.select("pkg", "file", F.explode("imports").alias("x")).select("pkg", "file", "x.module", "x.line")


def call_category(expression: Column) -> Column:
    """The category of a known call by its last name, null for others; exec of an object may be anything's."""
    name = _last(expression)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in t.CALL_CATEGORIES.items() for x in kv]), name)
    return F.when((name == "exec") & F.contains(expression, F.lit(".")), F.lit(None)).otherwise(known)


def file_calls(found: DataFrame) -> DataFrame:
    calls = found.select("pkg", "file", F.posexplode(F.filter("calls", lambda c: ~c["is_new"])).alias("pos", "x"))
    return calls.select("pkg", "file", "pos", "x.line", "x.expression", call_category(F.col("x.expression")).alias("category"), "x.scope")


def file_functions(found: DataFrame) -> DataFrame:
    """Named functions, functions held by variables, and methods, with the lines of their bodies."""
    return found.select("pkg", "file", F.explode("functions").alias("x")).select("pkg", "file", "x.*")
