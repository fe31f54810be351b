"""A corpus of source trees derived from documents: every document becomes a file of one of 40 projects, with names and
secrets put in by rule. The same expressions run in Spark and, as text, in other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions import paths as P

#: slot, variant, dir, name, inject
LAYOUT = [
    (0, 0, "", "Cargo.toml", ""), (0, 1, "", "package.json", ""), (0, 2, "", "pyproject.toml", ""),
    (1, 0, "", ".env", "aws"), (1, 1, "", ".env.production", "pwd"), (1, 2, "config", "app.cfg", "conn"),
    (2, 0, "target/debug", "app.txt", "aws"), (2, 1, "node_modules/pkg", "package.json", "ghp"), (2, 2, ".venv/lib", "x.py", "pwd"),
    (3, 0, ".git", "HEAD", ""), (3, 1, "", "next.config.mjs", ""), (3, 2, "", "manage.py", ""),
    (4, 0, "src", "main.rs", "ghp"), (4, 1, "src", "index.ts", "stripe_test"), (4, 2, "app", "models.py", "slack"),
    (5, 0, "", "Makefile", ""), (5, 1, "", "vite.config.ts", ""), (5, 2, "", "requirements.txt", ""),
    (6, 0, "certs", "server.pem", "pem"), (6, 1, "deploy", "id_rsa", "pem"), (6, 2, "deploy", "kubeconfig", "jwt"),
    (7, 0, "api/server", "go.mod", ""), (7, 1, "packages/ui", "package.json", "api"), (7, 2, "svc", "Gemfile", ""),
    (8, 0, "target/node_modules/q", "z.js", "aws"), (8, 1, "dist", "bundle.js", "stripe_live"), (8, 2, "pkg.egg-info", "PKG-INFO", ""),
    (9, 0, "", "config.json", "api"), (9, 1, ".next", "cache.txt", "gho"), (9, 2, "svc/config", "application.rb", ""),
    (10, 0, "a/b/c/d", "deep.txt", "aws"), (10, 1, "a/b/c/d/e", "deep.txt", "aws"), (10, 2, "vendor/lib", "y.go", "awssec"),
    (11, 0, "", "README.md", ""), (11, 1, "coverage", "lcov.txt", ""), (11, 2, "keys", "my-sa.json", "awssec"),
]
#: inject -> SQL text over v
INJECT = {
    "aws": "concat('AKIA', upper(substr(v, 1, 16)))", "ghp": "concat('ghp_', v, ' ghp_', v)", "gho": "concat('gho_', v)",
    "slack": "concat('xoxb-', v)", "stripe_live": "concat('sk_live_', v)", "stripe_test": "concat('sk_test_', v)",
    "pem": "'-----BEGIN RSA PRIVATE KEY-----'", "conn": "concat('postgres://app:', v, '@db/main')",
    "jwt": "concat('eyJ', v, '.eyJ', v, '.', v)", "api": "concat('api_key = \"', v, '\"')",
    "pwd": "concat('PASSWORD=', v)", "awssec": "concat('aws_secret_access_key = ', v)",
}


def _case(column: str, otherwise: str) -> str:
    at = {"dir": 2, "name": 3, "inject": 4}[column]
    return "case " + " ".join(f"when slot = {x[0]} and variant = {x[1]} then '{x[at]}'" for x in LAYOUT) + f" else {otherwise} end"


_INJECT = "case inject " + " ".join(f"when '{k}' then {v}" for k, v in INJECT.items()) + " else '' end"

#: DuckDB: relations corpus(root, path, text) and entries(root, path, kind, size_bytes, parts)
CORPUS_SQL = f"""
c0 as (select doc_id % 40 as p, doc_id // 40 as slot, (doc_id % 40) % 3 as variant, text as body,
       substr(md5(cast(doc_id % 7 as varchar)), 1, 24) as v from documents),
c1 as (select *, {_case('dir', "'src/s' || slot")} as dir, {_case('name', "'f' || slot || '.txt'")} as name, {_case('inject', "''")} as inject from c0),
corpus as (select 'corpus' as root, 'p' || lpad(cast(p as varchar), 2, '0') || '/' || case when dir = '' then '' else dir || '/' end || name as path,
       body || chr(10) || {_INJECT} as text from c1),
files as (select root, path, 'file' as kind, cast(strlen(text) as bigint) as size_bytes, string_split(path, '/') as parts from corpus),
dirs as (select distinct root, array_to_string(parts[1:i], '/') as path, parts[1:i] as parts from files, unnest(range(0, len(parts))) as t(i)),
entries as (select root, path, kind, size_bytes, parts from files
       union all select root, path, 'dir', 0, parts from dirs)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, path, text. A table of fewer splits than cores is dealt out first, as a scan is mostly work on its texts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < cores:
        d = d.repartition(cores)
    d = d.selectExpr(
        "doc_id % 40 as p", "doc_id div 40 as slot", "(doc_id % 40) % 3 as variant", "text as body",
        "substr(md5(cast(doc_id % 7 as string)), 1, 24) as v",
    )
    d = d.selectExpr("*", f"{_case('dir', 'concat(\"src/s\", slot)')} as dir", f"{_case('name', 'concat(\"f\", slot, \".txt\")')} as name", f"{_case('inject', '\"\"')} as inject")
    return d.selectExpr(
        "'corpus' as root", "concat('p', lpad(cast(p as string), 2, '0'), '/', case when dir = '' then '' else concat(dir, '/') end, name) as path",
        f"concat(body, '\\n', {_INJECT}) as text",
    )


def entries_of(contents: DataFrame) -> DataFrame:
    """root, path, kind, size_bytes, parts: the files of contents and every directory above them."""
    files = contents.select("root", "path", F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size_bytes")).withColumn("parts", P.parts("path"))
    dirs = files.select("root", F.explode(P.ancestors(F.col("parts"))).alias("path")).distinct()
    dirs = dirs.select("root", "path", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size_bytes"), P.parts("path").alias("parts"))
    return files.unionByName(dirs)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(corpus(spark, sf_dir))
