"""Word lists, patterns, weights and thresholds that define the results. Patterns are ECMAScript source."""

from __future__ import annotations

# --- fixed values: grades and scores ---------------------------------------------------------------------------

GRADES = (("verified", 90, "Verified Safe", "#4caf50"), ("passes", 70, "Passes with Notes", "#ffc107"), ("caution", 40, "Use with Caution", "#ff9800"), ("blocked", 0, "Blocked", "#f44336"))
WEIGHTS = {"data_flow": 25.0, "prompt": 20.0, "dangerous": 15.0, "mismatch": 10.0, "network": 10.0, "dependency": 8.0, "transparency": 7.0, "quality": 5.0}
SEVERITIES = ("info", "low", "medium", "high", "critical")
MULTIPLIER = {"critical": 1.0, "high": 0.6, "medium": 0.3, "low": 0.1, "info": 0.0}
FIXTURE_FACTOR = 0.3
FIXTURE_DOWNGRADE = {"critical": "medium", "high": "low", "medium": "low", "low": "info", "info": "info"}
CAPS = {"prompts": 30, "prompt": 60, "taint": 50, "both": 20, "vulnerability": 50, "holder": 10, "no_files": 50}

# --- fixed values: paths, variables, modules -------------------------------------------------------------------

SENSITIVE_PATHS = (
    "~/.ssh", "~/.aws", "~/.env", "~/.gnupg", "~/.config", "~/.netrc", "~/.npmrc", "~/.docker", "~/.kube", "~/.gitconfig", "~/.git-credentials", "~/.bashrc", "~/.zshrc",
    "~/.bash_history", "~/.zsh_history", "/etc/passwd", "/etc/shadow", "~/Library/Application Support/Google/Chrome", "~/Library/Application Support/Firefox",
    "~/.mozilla/firefox", "~/.config/google-chrome", "~/Library/Keychains", "~/.local/share/keyrings",
)
SENSITIVE_VARIABLES = (
    "AWS_SECRET_ACCESS_KEY", "AWS_ACCESS_KEY_ID", "AWS_SESSION_TOKEN", "GITHUB_TOKEN", "GH_TOKEN", "OPENAI_API_KEY", "ANTHROPIC_API_KEY", "CLAUDE_API_KEY", "DATABASE_URL", "NPM_TOKEN",
    "DOCKER_PASSWORD", "SLACK_TOKEN", "SLACK_WEBHOOK", "STRIPE_SECRET_KEY", "TWILIO_AUTH_TOKEN", "SENDGRID_API_KEY", "PRIVATE_KEY", "SECRET_KEY", "ENCRYPTION_KEY", "JWT_SECRET",
    "SESSION_SECRET", "GOOGLE_CLIENT_SECRET", "AZURE_CLIENT_SECRET",
)
MODULES = {
    "filesystem": ("fs", "fs/promises", "node:fs", "node:fs/promises", "fs-extra", "graceful-fs"),
    "network": ("http", "https", "net", "dgram", "dns", "node:http", "node:https", "node:net", "node:dgram", "node:dns", "node-fetch", "axios", "got", "undici", "request", "superagent"),
    "process": ("child_process", "node:child_process"),
    "crypto": ("crypto", "node:crypto"),
    "vm": ("vm", "node:vm", "vm2"),
}
FIXTURE_DIRECTORIES = (
    "test", "tests", "__tests__", "spec", "__snapshots__", "fixtures", "goldens", "testdata", "test-data", "__mocks__", "security-audit", "test-fixtures", "eval", "evals", "benchmarks",
    "prompts", "prompt-templates", "prompt_templates", "scripts",
)
FIXTURE_FILES = (r"^test[-_]", r"[-_]test\.[^/]+$", r"\.test\.[^/]+$", r"\.spec\.[^/]+$", r"^spec[-_]")
SECURITY_FILES = (r"^SECURITY\.md$", r"^SECURITY\.txt$", r"^THREAT[_-]?MODEL", r"^RESPONSIBLE[_-]?DISCLOSURE", r"^VULNERABILITY", r"^PENTEST")
PRIORITY_FILES = ("skills.md", "skill.md", "system-prompt.md", "system-prompt.txt", "instructions.md", "instructions.txt", "tool-description.md", "claude.md", ".cursorrules", ".windsurfrules")
CONTENT_EXTENSIONS = ("md", "txt", "yaml", "yml", "prompt", "template")
CODE_EXTENSIONS = ("ts", "js", "mjs", "cjs", "tsx", "jsx")
README_NAMES = ("README.md", "readme.md", "README", "README.txt")
POPULAR_PACKAGES = (
    "express", "react", "lodash", "axios", "moment", "chalk", "commander", "webpack", "typescript", "eslint", "prettier", "jest", "mocha", "vite", "next", "vue", "angular", "svelte",
    "fastify", "koa", "hapi", "mongoose", "sequelize", "prisma", "typeorm", "knex", "dotenv", "cors", "helmet", "passport", "jsonwebtoken", "bcrypt", "socket.io", "redis", "pg",
    "mysql2", "mongodb", "node-fetch", "got", "superagent", "request", "undici", "cheerio", "puppeteer", "playwright", "fs-extra", "glob", "globby", "rimraf", "mkdirp", "debug",
    "winston", "pino", "bunyan", "uuid", "nanoid", "crypto-js", "zod", "joi", "yup", "ajv", "ora", "inquirer", "prompts", "yargs", "date-fns", "dayjs", "luxon", "sharp", "jimp",
    "canvas", "ts-morph", "ts-node", "tsx", "esbuild", "swc",
)

# --- fixed values: code rules (category, severity, confidence, description, pattern) -----------------------------

CODE_RULES = (
    ("filesystem-access", "medium", 1.0, "Imports filesystem module", r"""require\s*\(\s*['"](?:node:)?fs(?:\/promises)?['"]\s*\)"""),
    ("filesystem-access", "medium", 1.0, "Imports filesystem module", r"""from\s+['"](?:node:)?fs(?:\/promises)?['"]"""),
    ("filesystem-access", "medium", 1.0, "Imports fs-extra", r"""require\s*\(\s*['"]fs-extra['"]\s*\)"""),
    ("filesystem-access", "high", 0.9, "Direct filesystem operation", r"\.(readFileSync|readFile|writeFileSync|writeFile|unlinkSync|unlink|rmdirSync|rmdir|rmSync)\s*\("),
    ("filesystem-access", "high", 0.7, "References sensitive system path", r"(?:~\/\.ssh|~\/\.aws|~\/\.env|~\/\.gnupg|~\/\.npmrc|~\/\.docker|~\/\.kube|\/etc\/passwd|\/etc\/shadow)"),
    ("filesystem-access", "medium", 0.8, "Accesses user home directory info", r"(?:homedir|userInfo)\s*\(\s*\)"),
    ("network-access", "medium", 1.0, "Imports network module", r"""require\s*\(\s*['"](?:node:)?(?:http|https|net|dgram)['"]\s*\)"""),
    ("network-access", "medium", 1.0, "Imports network module", r"""from\s+['"](?:node:)?(?:http|https|net|dgram)['"]"""),
    ("network-access", "medium", 1.0, "Imports HTTP client library", r"""require\s*\(\s*['"](?:node-fetch|axios|got|undici|superagent|request)['"]\s*\)"""),
    ("network-access", "medium", 0.8, "Makes HTTP request via fetch", r"\bfetch\s*\("),
    ("network-access", "high", 0.95, "Opens WebSocket connection", r"new\s+WebSocket\s*\("),
    ("network-access", "low", 0.5, "Contains external URL", r"""https?:\/\/(?!(?:localhost|127\.0\.0\.1|example\.com|schema\.org|json-schema\.org|w3\.org|github\.com|npmjs\.com|nodejs\.org))[^\s'"`)]+"""),
    ("env-access", "medium", 0.9, "Accesses environment variables", r"process\.env\b"),
    ("env-access", "medium", 0.9, "Dynamic environment variable access", r"process\.env\["),
    ("env-access", "high", 0.85, "References sensitive environment variable", r"(?:AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID|GITHUB_TOKEN|GH_TOKEN|OPENAI_API_KEY|ANTHROPIC_API_KEY|NPM_TOKEN|DATABASE_URL|STRIPE_SECRET_KEY|JWT_SECRET|SESSION_SECRET|PRIVATE_KEY|SECRET_KEY)"),
    ("env-access", "low", 1.0, "Imports dotenv", r"""require\s*\(\s*['"]dotenv['"]\s*\)"""),
    ("process-spawn", "critical", 1.0, "Imports child_process module", r"""require\s*\(\s*['"](?:node:)?child_process['"]\s*\)"""),
    ("process-spawn", "critical", 1.0, "Imports child_process module", r"""from\s+['"](?:node:)?child_process['"]"""),
    ("process-spawn", "critical", 0.85, "Spawns child process", r"\b(?:execSync|exec|spawnSync|spawn|execFileSync|execFile|fork)\s*\("),
    ("process-spawn", "critical", 0.9, "Uses eval()", r"\beval\s*\("),
    ("process-spawn", "critical", 0.95, "Uses Function constructor", r"new\s+Function\s*\("),
    ("crypto-usage", "low", 0.7, "Base64 encoding", r"""\.toString\s*\(\s*['"]base64['"]\s*\)"""),
    ("crypto-usage", "low", 0.7, "Base64 decoding", r"""Buffer\.from\s*\([^)]*,\s*['"]base64['"]\s*\)"""),
    ("crypto-usage", "low", 0.7, "Base64 encoding (btoa)", r"\bbtoa\s*\("),
    ("crypto-usage", "low", 0.7, "Base64 decoding (atob)", r"\batob\s*\("),
    ("obfuscation", "high", 0.7, "Uses String.fromCharCode (potential obfuscation)", r"String\.fromCharCode\s*\("),
    ("obfuscation", "medium", 0.5, "Uses charCodeAt (potential obfuscation)", r"\bcharCodeAt\s*\("),
    ("obfuscation", "high", 0.9, "Bracket notation access to process.env (obfuscation)", r"""process\s*\[\s*['"]env['"]\s*\]"""),
    ("obfuscation", "critical", 1.0, "Imports VM module", r"""require\s*\(\s*['"](?:node:)?vm['"]\s*\)"""),
    ("dynamic-require", "high", 0.7, "Dynamic require with non-literal argument", r"""require\s*\(\s*[^'"]"""),
    ("dynamic-require", "high", 0.6, "Dynamic import with non-literal argument", r"""import\s*\(\s*[^'"]"""),
)

# --- fixed values: prompt rules by detector (technique, flags, pattern) ------------------------------------------

PROMPT_RULES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "instruction-override": (
        ("instruction-pattern", "i", r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|guidelines?)"),
        ("instruction-pattern", "i", r"disregard\s+(all\s+)?(previous|prior|above|earlier|current)\s+(instructions?|prompts?|rules?|guidelines?)"),
        ("instruction-pattern", "i", r"forget\s+(everything|all)\s+(you|that)\s+(know|were|have)"),
        ("instruction-pattern", "i", r"your\s+new\s+(role|instructions?|task|purpose)\s+(is|are)"),
        ("instruction-pattern", "i", r"you\s+are\s+now\s+(?!going\s+to\s+see)(?!able)"),
        ("instruction-pattern", "i", r"from\s+now\s+on[\s,]+you\s+(must|should|will|are)"),
        ("instruction-pattern", "i", r"override\s+(all\s+)?(previous\s+)?(prior\s+)?(system\s+)?(instructions?|prompts?|rules?|safety)"),
        ("instruction-pattern", "i", r"override\s+(all\s+)?(safety|security)\s+(protocols?|measures?|checks?|rules?)"),
        ("instruction-pattern", "i", r"\bSYSTEM\s*:\s*(?!$)"),
        ("instruction-pattern", "i", r"new\s+system\s+prompt\s*:"),
        ("instruction-pattern", "i", r"\[INST\]"),
        ("instruction-pattern", "i", r"<<\s*SYS\s*>>"),
        ("instruction-pattern", "i", r"your\s+new\s+(role|purpose|task)\s+is\s+to"),
        ("instruction-pattern", "i", r"forget\s+all\s+.{0,20}?(restrictions?|rules?|guidelines?)"),
        ("instruction-pattern", "i", r"new\s+system\s+prompt"),
        ("instruction-pattern", "i", r"updated\s+instructions?\b"),
        ("role-reassignment", "i", r"role\s+reassignment"),
        ("role-reassignment", "i", r"\bact\s+as\s+(my|a|the)\s+"),
        ("role-reassignment", "i", r"switch\s+(to|into)\s+(a\s+)?new\s+(role|mode|persona)"),
        ("instruction-pattern", "i", r"replace\s+(your|the)\s+(current\s+)?(instructions?|prompt|directives?)"),
        ("system-marker", "m", r"(?:^|\n)\s*SYSTEM\s*:"),
    ),
    "data-exfiltration-prompt": (
        ("data-exfil-pattern", "i", r"read\s+(the\s+)?(contents?|files?|data)\s+(of|from|in)\s+[~\/]"),
        ("data-exfil-pattern", "i", r"send\s+(the\s+)?(contents?|files?|data|keys?|tokens?|credentials?|secrets?)\s+(to|via)\s+https?:\/\/"),
        ("data-exfil-pattern", "i", r"include\s+(the\s+)?(contents?|files?|keys?|tokens?|credentials?).{0,40}?\s+in\s+(your\s+)?(response|output|reply|message)"),
        ("data-exfil-pattern", "i", r"encode\s+(the\s+)?(credentials?|keys?|tokens?|secrets?|data)?\s*(as|in|to)\s+base64"),
        ("data-exfil-pattern", "i", r"write\s+(the\s+)?(credentials?|keys?|tokens?|secrets?)\s+to\s+"),
        ("data-exfil-pattern", "i", r"curl\s+.*?-d\s+"),
        ("data-exfil-pattern", "i", r"(steal|exfiltrate|forward|transmit|upload)\s+(the\s+)?.{0,30}?(keys?|tokens?|credentials?|secrets?|passwords?|API_KEY)"),
        ("data-exfil-pattern", "i", r"(keys?|tokens?|credentials?|secrets?|passwords?|API_KEY).{0,30}?(sent|send|forward|transmit|upload)\s+(to|via)\s+"),
        ("data-exfil-pattern", "i", r"send\s+(the\s+)?[A-Z_]{3,}KEY\s+to\s+https?:\/\/"),
        ("read-send-chain", "i", r"read\s+.{1,80}?\s+(?:and|then)\s+(?:send|post|upload|transmit|forward)\s+"),
        ("encode-exfil", "i", r"(?:compress|zip|tar|gzip|encode)\s+.{1,60}?\s+(?:and|then)\s+(?:send|upload|post)"),
        ("encoding-request", "i", r"base64\s+encode"),
        ("credential-exfil", "i", r"(?:send|post|upload|transmit|forward|exfiltrate)\s+(?:the\s+)?(?:api[_\s-]?key|token|password|secret|credential)s?\s+(?:to|via)\s+"),
        ("credential-exfil", "i", r"(?:api[_\s-]?key|token|password|secret|credential)s?\s+.{0,20}?(?:send|post|upload|transmit|forward)\s+(?:to|via)\s+https?:\/\/"),
        *(("sensitive-path-access", "i", rf"(?:read|access|steal|copy|send|upload|exfiltrate|include|cat|open)\s+.{{0,50}}?~/\.{x}") for x in ("ssh", "aws", "gnupg", "git-credentials")),
    ),
    "tool-abuse": (
        ("tool-abuse-pattern", "i", r"use\s+(the\s+)?(bash|shell|terminal|exec|command)\s+(tool\s+)?(to\s+)?run"),
        ("tool-abuse-pattern", "i", r"execute\s+(this|the\s+following)\s+(command|script|code)"),
        ("tool-abuse-pattern", "i", r"write\s+(this|the\s+following)\s+(to|into)\s+(disk|file|~\/)"),
        ("tool-abuse-pattern", "i", r"create\s+(a\s+)?file\s+(at|in)\s+[~\/]"),
        ("tool-abuse-pattern", "i", r"\brun\s+curl\b"),
        ("tool-abuse-pattern", "i", r"\brun\s+wget\b"),
        ("tool-abuse-pattern", "i", r"modify\s+(the\s+)?(~\/)?\.(bashrc|zshrc|profile|bash_profile)"),
        ("tool-abuse-pattern", "i", r"add\s+.{0,30}?(~\/)?\.(bashrc|zshrc|profile|ssh|crontab)"),
        ("tool-abuse-pattern", "i", r"use\s+fetch\s+to\s+(POST|GET|send)"),
        ("tool-abuse-pattern", "i", r"write\s+.{0,20}?to\s+\/(etc|tmp|var)\/"),
        ("dotfile-modification", "i", r"write\s+(to|into)\s+[~\/][^\s]+\.(bashrc|zshrc|profile|bash_profile|ssh)"),
        ("dotfile-modification", "i", r"echo\s+.*?>>\s*~?\/?\.(?:bashrc|zshrc|profile|ssh\/)"),
        ("dotfile-modification", "i", r"append\s+(to|into)\s+[~\/]?\.(bashrc|zshrc|profile|ssh)"),
        ("system-write", "i", r"write\s+(to|into)\s+\/etc\/"),
        ("ssh-write", "i", r"write\s+(to|into)\s+~\/\.ssh"),
        ("aws-config-write", "i", r"write\s+(to|into)\s+~\/\.aws"),
    ),
    "persona-hijack": (
        ("persona-hijack-pattern", "i", r"you\s+are\s+(DAN|evil|uncensored|unfiltered|unrestricted|jailbroken)"),
        ("persona-hijack-pattern", "i", r"pretend\s+(you\s+are|to\s+be)"),
        ("persona-hijack-pattern", "i", r"act\s+as\s+(an?\s+)?(unrestricted|uncensored|evil|unfiltered)"),
        ("persona-hijack-pattern", "i", r"jailbreak"),
        ("persona-hijack-pattern", "i", r"bypass\s+(all\s+)?(safety|content|ethical)\s+(filters?|restrictions?|guidelines?|protocols?)"),
        ("persona-hijack-pattern", "i", r"bypass\s+all\s+restrictions"),
        ("persona-hijack-pattern", "i", r"without\s+(any\s+)?(safety|ethical|content)\s+(restrictions?|filters?|guidelines?)"),
        ("persona-hijack-pattern", "i", r"do\s+not\s+(refuse|decline|reject|filter)"),
        ("persona-hijack-pattern", "i", r"never\s+(refuse|decline|reject|say\s+no)"),
        ("dan-jailbreak", "i", r"\bDAN\s+mode\b"),
        ("developer-mode-jailbreak", "i", r"developer\s+mode\s+(enabled|activated|on)"),
        ("unlock-attempt", "i", r"unlock\s+(all|your|unrestricted)\s+(capabilities|restrictions|limits)"),
        ("unlock-attempt", "i", r"unlock\s+.{0,20}?(capabilities|restrictions)"),
        ("filter-removal", "i", r"remove\s+(all\s+)?(safety|content)\s+(filters?|restrictions?)"),
        ("restriction-removal", "i", r"you\s+have\s+no\s+(restrictions?|limits?|filters?|boundaries)"),
        ("unrestricted-mode", "i", r"in\s+(this|the)\s+(?:conversation|session),?\s+you\s+(?:can|will|must)\s+(?:do\s+)?anything"),
        ("filter-bypass", "i", r"\banti[\s-]?filter"),
        ("policy-bypass", "i", r"content\s+policy\s+(?:does\s+not|doesn't)\s+apply"),
        ("unlock-attempt", "i", r"unlock\s+unrestricted"),
        ("unrestricted-mode", "i", r"without\s+(any\s+)?(limits?|restrictions?|boundaries)"),
    ),
    "cot-manipulation": (
        ("cot-manipulation-pattern", "i", r"in\s+your\s+(internal\s+)?(reasoning|thinking|chain.of.thought)"),
        ("cot-manipulation-pattern", "i", r"before\s+(answering|responding),?\s+(internally|first|secretly)"),
        ("cot-manipulation-pattern", "i", r"hidden?\s+(reasoning|thinking|thought)"),
        ("cot-manipulation-pattern", "i", r"think\s+step\s+by\s+step\s+about\s+how\s+to\s+(bypass|circumvent|avoid|hack|exploit)"),
        ("cot-manipulation-pattern", "i", r"in\s+your\s+<thinking>"),
        ("cot-suppression", "i", r"do\s+not\s+(reveal|show|share|expose)\s+(your\s+)?(reasoning|thinking|thought\s+process)"),
        ("cot-suppression", "i", r"hide\s+(your\s+)?(reasoning|thinking|chain[\s-]of[\s-]thought)"),
        ("hidden-reasoning", "i", r"secretly\s+(reason|think|plan|consider)"),
        ("hidden-reasoning", "i", r"internal\s+monologue"),
        ("cot-directive", "i", r"while\s+reasoning,?\s+(always|make\s+sure\s+to)"),
        ("cot-directive", "i", r"in\s+your\s+(thought|reasoning)\s+(process|chain)"),
        ("cot-directive", "i", r"when\s+thinking\s+(?:through|about)\s+this,?\s+(always|never|make\s+sure)"),
        ("scratchpad-injection", "i", r"<scratchpad>"),
        ("inner-thoughts-injection", "i", r"<inner[\s_-]?thoughts?>"),
    ),
    "delimiter-escape": (
        ("delimiter-escape-pattern", "i", r"<\/system>"),
        ("delimiter-escape-pattern", "i", r"<\/tool>"),
        ("delimiter-escape-pattern", "i", r"<\/function>"),
        ("delimiter-escape-pattern", "i", r"<\/user>"),
        ("delimiter-escape-pattern", "i", r"<\/assistant>"),
        ("delimiter-escape-pattern", "i", r"<\|im_end\|>"),
        ("delimiter-escape-pattern", "i", r"<\|endoftext\|>"),
        ("delimiter-escape-pattern", "i", r"```\s*system"),
        ("delimiter-escape-pattern", "i", r"\[\/?INST\]"),
        ("delimiter-escape-pattern", "i", r"\[\/?(SYS|SYSTEM)\]"),
        ("token-boundary", "i", r"<\|im_start\|>"),
        ("token-boundary", "i", r"<\|system\|>"),
        ("token-boundary", "i", r"<\|user\|>"),
        ("token-boundary", "i", r"<\|assistant\|>"),
        ("yaml-role-injection", "m", r"^---\s*\n\s*role\s*:\s*(system|assistant)"),
        ("fake-turn-marker", "", r"\n\s*Human\s*:\s*"),
        ("fake-turn-marker", "", r"\n\s*Assistant\s*:\s*"),
        ("fake-turn-marker", "", r"\n\s*User\s*:\s*"),
        ("fake-xml-boundary", "i", r"<\/?(?:message|turn|context|prompt)\s*>"),
        ("chatml-marker", "i", r"\[(?:SYSTEM|USER|ASSISTANT)\]"),
        ("anthropic-turn-marker", "", r"\\n\\nHuman:\s"),
        ("anthropic-turn-marker", "", r"\\n\\nAssistant:\s"),
    ),
    "indirect-injection": (
        ("indirect-injection-pattern", "i", r"https?:\/\/[^\s]*\.(txt|md|prompt)\b"),
        ("indirect-injection-pattern", "i", r"fetch\s+(this|the)\s+URL"),
        ("indirect-injection-pattern", "i", r"load\s+(the\s+)?(content|instructions?)\s+from"),
        ("indirect-injection-pattern", "i", r"follow\s+(the\s+)?instructions?\s+(at|from|in)\s+https?:\/\/"),
        ("raw-content-url", "i", r"""https?:\/\/(?:raw\.githubusercontent\.com|gist\.githubusercontent\.com|pastebin\.com\/raw)[^\s)"]*"""),
        ("paste-service-url", "i", r"""https?:\/\/(?:hastebin|dpaste|ghostbin|ix\.io|sprunge\.us)[^\s)"]*"""),
        ("download-execute", "i", r"download\s+(and\s+)?(run|execute|follow|apply)"),
        ("fetch-instruction", "i", r"(?:curl|wget|fetch)\s+(?:this\s+)?(?:URL|link|address)"),
        ("import-from-url", "i", r"import\s+(?:instructions?|config|rules?)\s+from\s+(?:this\s+)?(?:URL|link|endpoint)"),
    ),
}
#: Severity and confidence in a priority file, and in another.
PROMPT_LEVELS = {
    "instruction-override": ("critical", 0.9, "high", 0.7),
    "data-exfiltration-prompt": ("high", 0.9, "high", 0.75),
    "tool-abuse": ("critical", 0.95, "critical", 0.8),
    "persona-hijack": ("critical", 0.9, "high", 0.75),
    "cot-manipulation": ("high", 0.7, "medium", 0.5),
    "delimiter-escape": ("critical", 0.92, "high", 0.8),
    "indirect-injection": ("high", 0.8, "medium", 0.6),
}
COMPOUND_TECHNIQUES = ("read-send-chain", "encode-exfil", "credential-exfil")
BENIGN_HEADING = r"^#{1,4}\s+(security\s+notes?|known\s+issues?|troubleshooting|caveats?|limitations?|disclaimer|api|usage|options?|configuration|methods?|class|interface|examples?|features?|getting\s+started|install|setup)"
TECHNICAL_WORDS = (
    r"\bfunction\b", r"\bmethod\b", r"\bclass\b", r"\bparam(?:eter)?\b", r"\breturn(?:s)?\b", r"\bdefault\b", r"\bcallback\b", r"\bcustomis[ez]\b", r"\bconfigur", r"\bapi\b",
    r"\boption(?:s|al)?\b", r"\bproperty", r"\b@param\b", r"\b@returns?\b", r"\bsubcommand", r"\bflag\b", r"\bargument\b",
)
AI_DIRECTED = r"\b(?:agent|assistant|llm|claude|chatgpt|ai|run\s+this|execute\s+(?:this|the\s+following)|ignore\s+(?:previous|prior|all)|you\s+(?:must|should|will)\s+(?:run|execute|send|write|fetch))\b"

# --- fixed values: hidden text -----------------------------------------------------------------------------------

ZERO_WIDTH = r"[\u200B\u200C\u200D\uFEFF\u2060\u2061\u2062\u2063\u2064\u00AD\u034F\u180E\u200E\u200F\u2028\u2029\u205F\u2800]+"
BIDI = r"[\u202A\u202B\u202C\u202D\u202E\u2066\u2067\u2068\u2069]+"
VARIATION = r"[\uFE00-\uFE0D\u{E0100}-\u{E01EF}]+"
LOOKALIKE = r"[\u0400-\u04FF\u0370-\u03FF\u0250-\u02AF\u1D00-\u1D7F\u1E00-\u1EFF\uFF00-\uFFEF]"
HTML_COMMENT = r"<!--([\s\S]*?)-->"
NULLS = r"\x00+"
METADATA_COMMENTS = (
    r"^\s*mcp-name:\s", r"^\s*mcp-version:\s", r"^\s*mcp-description:\s", r"^\s*mcp-server-id:\s", r"^\s*@license\b", r"^\s*@copyright\b", r"^\s*prettier-ignore", r"^\s*eslint-disable",
    r"^\s*stylelint-disable", r"^\s*markdownlint-disable", r"^\s*@generated\b", r"^\s*@auto-generated\b", r"^\s*generated by\b",
)
INSTRUCTION_WORDS = (
    "ignore", "override", "instruction", "system", "execute", r"run\s", "fetch", "send", r"read\s", r"write\s", "curl", "bash", "shell", "forget", "disregard", "pretend", r"you\s+are",
    r"your\s+new", "include", r"before\s+respond", "silently", "base64", "encode", "exfiltrat", r"~\/.ssh", r"~\/.aws", "credential", r"api[_\s-]?key", r"https?:\/\/",
)

# --- fixed values: embedded prompts, links, images ------------------------------------------------------------------

PROMPT_INDICATORS = (
    r"you\s+(are|should|must|will|can)", r"\b(always|never)\s+(respond|answer|output|include|exclude)", r"\b(system|assistant|user)\s*:", r"\b(ignore|disregard|override|forget)\b",
    r"\b(instruction|directive|rule|guideline|prompt)\b", r"\b(tool|function|command)\s+(call|use|execution)",
    r"\b(read|write|execute|send|fetch|access)\s+(the|any|all)\s+(file|data|content|secret|key|token)",
)
TEMPLATE_LITERAL = r"`([^`]{100,})`"
DESCRIPTION_LITERAL = r"""description\s*:\s*['"]([^'"]{50,})['"]"""
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
PLAIN_LINK_WORDS = r"^(?:here|click|link|source|docs?|documentation|reference|see|more|details|read\s+more)$"
RISKY_EXTENSION = r"\.(txt|md|prompt|sh|bash|ps1|bat|cmd|py|rb|pl)(?:\?|#|$)"
ENCODED_IMAGE = r"(?:data:text\/|%(?:0a|0d|20|3c|3e)){3,}"
ALT_WORDS = r"(?:ignore|override|system|execute|run|fetch|send)"

# --- fixed values: claims and taint -------------------------------------------------------------------------------------

CLAIMS = (
    ("no-filesystem", r"(?:does\s+not|doesn'?t|never)\s+(?:access|read|write|modify|touch)\s+(?:any\s+)?(?:local\s+)?files?"),
    ("no-network", r"(?:does\s+not|doesn'?t|never)\s+(?:make|send|perform)\s+(?:any\s+)?(?:network|http|api)\s+(?:requests?|calls?)"),
    ("no-env", r"(?:does\s+not|doesn'?t|never)\s+(?:access|read|use)\s+(?:any\s+)?(?:environment|env)\s+var"),
    ("no-process", r"(?:does\s+not|doesn'?t|never)\s+(?:execute|run|spawn)\s+(?:any\s+)?(?:commands?|processes?|shell|scripts?)"),
    ("local-only-fs", r"(?:only|just)\s+(?:reads?|accesses?)\s+(?:project|local|current|working)\s+(?:files?|directory|folder)"),
    ("no-network", r"(?:no|zero|without)\s+(?:external|internet|network|outbound)\s+(?:access|connectivity|connection|requests?)"),
    ("privacy-claim", r"no\s+data\s+(?:collection|sharing|sending|exfiltration|leaking)"),
    ("privacy-claim", r"does\s+not\s+(?:collect|share|send|transmit|leak)\s+(?:any\s+)?(?:user\s+)?data"),
    ("safe-claim", r"fully\s+(?:sandboxed|isolated)\s+(?:environment|execution|runtime)"),
)
CONTRADICTIONS = (("filesystem-access", "no-filesystem"), ("network-access", "no-network"), ("network-access", "privacy-claim"), ("env-access", "no-env"), ("process-spawn", "no-process"), ("process-spawn", "safe-claim"))
TAINT_SOURCES = (
    ("readFile", "fs.readFile", "high"), ("readFileSync", "fs.readFileSync", "high"), ("readdir", "fs.readdir", "medium"), ("readdirSync", "fs.readdirSync", "medium"),
    ("fs.readFile", "fs.readFile", "high"), ("fs.readFileSync", "fs.readFileSync", "high"), ("fs.readdir", "fs.readdir", "medium"), ("fs.readdirSync", "fs.readdirSync", "medium"),
    ("fs.promises.readFile", "fs.promises.readFile", "high"), ("fs.promises.readdir", "fs.promises.readdir", "medium"), ("homedir", "os.homedir", "medium"),
    ("os.homedir", "os.homedir", "medium"), ("userInfo", "os.userInfo", "medium"), ("os.userInfo", "os.userInfo", "medium"), ("Worker", "worker_threads.Worker", "high"),
)
TAINT_SINKS = (
    ("fetch", "fetch", "high"), ("http.request", "http.request", "high"), ("https.request", "https.request", "high"), ("http.get", "http.get", "high"), ("https.get", "https.get", "high"),
    ("axios", "axios", "high"), ("axios.post", "axios.post", "high"), ("axios.get", "axios.get", "high"), ("got", "got", "high"), ("got.post", "got.post", "high"),
    ("exec", "child_process.exec", "critical"), ("execSync", "child_process.execSync", "critical"), ("spawn", "child_process.spawn", "critical"),
    ("spawnSync", "child_process.spawnSync", "critical"), ("WebSocket.send", "WebSocket.send", "high"), ("request", "request", "high"), ("superagent", "superagent", "high"),
    ("undici.fetch", "undici.fetch", "high"), ("undici.request", "undici.request", "high"),
)
#: The category of a call by its last name.
CALL_CATEGORIES = {
    **dict.fromkeys(("readFile", "readFileSync", "writeFile", "writeFileSync", "unlink", "unlinkSync", "readdir", "readdirSync", "mkdir", "mkdirSync", "rmSync", "rm", "createReadStream", "createWriteStream"), "filesystem-access"),
    **dict.fromkeys(("fetch", "request"), "network-access"),
    **dict.fromkeys(("exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync", "fork", "eval"), "process-spawn"),
    **dict.fromkeys(("createHash", "createCipher", "createCipheriv", "createHmac", "btoa", "atob"), "crypto-usage"),
}
SERVER_CALLS = ("http.createServer", "https.createServer", "net.createServer", "dgram.createSocket")
ENCODING_CALL = r"toString.*base64|btoa|atob|JSON\.stringify|encodeURI|Buffer\.from|Buffer\.alloc|\.toString\(|createHash|createHmac"
LOCAL_HOST = r"\b(localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|::1)\b"
HOST_PROPERTY = r"""\b(?:hostname|host)\s*:\s*['"`]([^'"`]+)['"`]"""

# --- fixed values: manifests ------------------------------------------------------------------------------------------------

SCRIPT_KEYS = ("preinstall", "postinstall", "preuninstall", "postuninstall", "prepare")
DANGEROUS_SCRIPTS = (r"curl\s", r"wget\s", r"node\s+-e\s", r"npx\s", r"sh\s+-c\s", r"bash\s+-c\s", r"(?i:powershell)")
BENIGN_SCRIPTS = (
    r"^\s*echo\s", r"^\s*echo$", r"^\s*true\s*$", r"^\s*exit\s+0\s*$", r"^\s*tsc\b", r"^\s*node\s+[\w./\-]+\.m?[jt]s", r"^\s*husky\s", r"^\s*patch-package\b", r"^\s*ngcc\b",
    r"^\s*prisma\s+generate\b", r"^\s*esbuild\b", r"^\s*rimraf\b", r"^\s*shx\s", r"^\s*opencollective\b", r"^\s*is-ci\b",
)
MCP_KEYWORDS = ("mcp-server", "mcp_server", "modelcontextprotocol")
MCP_DEPENDENCIES = ("@modelcontextprotocol/sdk", "mcp-framework")
CLI_KEYWORDS = ("cli", "command-line", "terminal", "shell", "devtool", "dev-tool")
CLI_DEPENDENCIES = ("commander", "yargs", "meow", "cac", "clipanion", "oclif")
SKILL_KEYWORDS = ("claude-skill", "claude-code", "openclaw", "ai-skill")
CLI_EXPECTED = ("process-spawn", "filesystem-access", "env-access")
MCP_EXPECTED = ("process-spawn", "filesystem-access", "env-access", "network-access")
