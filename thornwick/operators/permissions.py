"""The permission manifest that code findings imply: paths, hosts, variables, commands, in order of finding, distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def path_of(text: Column) -> Column:
    quoted = F.regexp_extract(text, r"""['"`]((?:~/|/|\./)[^'"`]+)['"`]""", 1)
    home = F.regexp_extract(text, r"""(~/\.\w+[^\s'"]*)""", 1)
    return F.when(quoted != "", quoted).when(home != "", home).otherwise("unknown path")


def classified(findings: DataFrame) -> DataFrame:
    """findings with what each adds: read, write, delete, outbound, inbound, domain, bulk, variables, command."""
    text = F.concat_ws(" ", F.coalesce("snippet", F.lit("")), "description")
    fs, net, env, spawn = (F.col("category") == c for c in ("filesystem-access", "network-access", "env-access", "process-spawn"))
    writes, deletes = _has(text, "write|mkdir|appendFile|createWriteStream"), _has(text, "unlink|rmdir|rm|rmSync|delete")
    inbound = _has(text, r"createServer|listen\(|\.listen")
    some = lambda x: F.when(x != "", x)
    variables = F.array_compact(F.array(some(F.regexp_extract(text, r"process\.env\.(\w+)", 1)), some(F.regexp_extract(text, r"""process\.env\[['"](\w+)['"]\]""", 1))))
    return findings.withColumns(
        {
            "p_write": F.when(fs & writes, path_of(text)),
            "p_delete": F.when(fs & ~writes & deletes, path_of(text)),
            "p_read": F.when(fs & ~writes & ~deletes, path_of(text)),
            "p_inbound": net & inbound,
            "p_outbound": F.when(net & ~inbound, F.col("description")),
            "p_domain": F.when(net & ~inbound, some(F.regexp_extract(text, r"""https?://([^/\s'"]+)""", 1))),
            "p_bulk": env & _has(text, r"Object\.keys|Object\.entries|\.\.\.process\.env|bulk"),
            "p_variables": F.when(env, variables).otherwise(F.array().cast("array<string>")),
            "p_command": F.when(spawn, some(F.regexp_extract(F.coalesce("snippet", F.lit("")), r"""(?:exec|spawn|execSync|spawnSync|execFile)\s*\(\s*['"`]([^'"`]+)""", 1))),
        }
    )


def manifest(findings: DataFrame) -> DataFrame:
    """One row a package, from findings with pkg, category, description, snippet and a total order ord. Values are made
    distinct before a package's are gathered, so its row is as large as what it says."""
    rows = classified(findings)
    lists = ("read", "write", "delete", "outbound", "domain", "command")
    said = F.concat(*[F.when(F.col(f"p_{x}").isNotNull(), F.array(F.struct(F.lit(x).alias("k"), F.col(f"p_{x}").alias("v"), F.lit(0).alias("i")))).otherwise(F.array()) for x in lists], F.transform("p_variables", lambda v, i: F.struct(F.lit("variable").alias("k"), v.alias("v"), i.alias("i"))))
    first = rows.select("pkg", "ord", F.explode(said).alias("x")).groupBy("pkg", "x.k", "x.v").agg(F.min(F.struct("ord", "x.i")).alias("at"))
    of = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("k") == k, F.struct("at", "v")))), lambda x: x["v"])
    gathered = first.groupBy("pkg").agg(*[of(k).alias(n) for k, n in (("read", "read"), ("write", "write"), ("delete", "delete"), ("outbound", "outbound"), ("domain", "domains"), ("variable", "variables"), ("command", "commands"))])
    scripts = F.sort_array(F.collect_list(F.when((F.col("category") == "install-scripts") & (F.coalesce("snippet", F.lit("")) != ""), F.struct("ord", F.col("snippet").alias("v")))))
    flags = rows.groupBy("pkg").agg(
        F.max("p_inbound").alias("inbound"),
        F.max("p_bulk").alias("bulk"),
        F.max(F.col("category") == "process-spawn").alias("spawn"),
        F.max(F.col("category") == "crypto-usage").alias("crypto"),
        F.max(F.col("category") == "dynamic-require").alias("native_modules"),
        F.transform(scripts, lambda x: x["v"]).alias("install_scripts"),
    )
    none = F.array().cast("array<string>")
    names = ("read", "write", "delete", "outbound", "domains", "variables", "commands")
    both = flags.join(gathered, "pkg", "left").withColumns({n: F.coalesce(n, none) for n in names})
    return both.select("pkg", "read", "write", "delete", "outbound", "inbound", "domains", "variables", "bulk", "spawn", "commands", "crypto", "native_modules", "install_scripts")
