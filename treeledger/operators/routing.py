"""Plans: which file is pruned, stashed, too deep, denied or packed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.rules import risk_rank
from treeledger.operators import secrets

PACK_DEPTH = 64


def stash_plan(contents: DataFrame, min_risk: str = "High") -> DataFrame:
    """root, path, risk, size_bytes of the files to put away. All from one row: no shuffle."""
    rows = contents.withColumn("size_bytes", F.octet_length("text").cast("long"))
    found = secrets.scan_secrets(rows, min_risk=min_risk, keep=("size_bytes",))
    return found.select("root", "path", secrets.risk_name(F.col("risk_rank")).alias("risk"), "size_bytes")


def stash_only(requests: DataFrame, entries: DataFrame, contents: DataFrame, min_risk: str = "High", strict: bool = False) -> DataFrame:
    """root, path, state, risk, size_bytes of an explicit list (root, path) of files to put away, each once: selected,
    below_risk, missing, not_a_file or outside (it is absolute or climbs above the root; named as it was written). Paths are
    resolved before they are compared, so that ./a, a/./ and b/../a are the one file a. Neither the skip policy nor the
    depth applies. With strict, the last three are errors."""
    asked = requests.select("root", "path", secrets.once(P.resolved(F.col("path"))).alias("own"))
    asked = asked.select("root", F.coalesce(P.join_parts(F.col("own")), F.col("path")).alias("path"), F.col("own").isNull().alias("outside")).distinct()
    inside = asked.where(~F.col("outside")).select("root", "path")
    found = secrets.scan_secrets(contents.join(inside, ["root", "path"], "left_semi"), min_risk=min_risk, walk=False)
    listed = entries.select("root", "path", "kind", "size_bytes").withColumn("outside", F.lit(False))
    rows = asked.join(listed, ["root", "path", "outside"], "left")
    risks = found.select("root", "path", secrets.risk_name(F.col("risk_rank")).alias("risk"), F.lit(False).alias("outside"))
    rows = rows.join(risks, ["root", "path", "outside"], "left")
    state = F.when(F.col("outside"), "outside").when(F.col("kind").isNull(), "missing").when(F.col("kind") != "file", "not_a_file")
    if strict:
        state = F.when(state.isNotNull(), F.raise_error(F.concat_ws(": ", state, "path")))
    state = F.coalesce(state, F.when(F.col("risk").isNull(), "below_risk").otherwise("selected"))
    return rows.select("root", "path", state.alias("state"), "risk", F.when(F.col("kind") == "file", F.col("size_bytes")).alias("size_bytes"))


def routes(
    contents: DataFrame, stash: bool = True, content_min: str = "Critical", pack_depth: int = PACK_DEPTH,
    policy: P.Policy = P.DEFAULT, patterns=None, markers=None,
) -> DataFrame:
    """root, project, path, size_bytes, route: the first that applies of pruned, stash, too_deep, deny_name,
    deny_content, pack. A project is a first-level directory; depths and pruning count from it, except that the stash
    scan counts from the root. All from one row: no shuffle."""
    rows = contents.withColumn("parts", P.parts("path")).withColumn("name", F.element_at("parts", -1))
    own = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(1)))
    secrets.check_rules(patterns, markers)
    names = secrets.name_sources(F.col("name"), patterns).cast(secrets._SOURCE)
    inside = secrets.content_sources_of(F.col("text"), markers)
    rows = rows.select(
        "root", "path", "parts", F.octet_length("text").cast("long").alias("size_bytes"),
        P.skipped(own, F.lit("file"), policy).alias("pruned"),
        secrets.once(F.struct(names.alias("names"), inside.alias("inside"))).alias("s"),
    )
    rows = rows.select("*", "s.names", "s.inside")
    top = lambda c: F.coalesce(F.array_max(F.transform(c, lambda s: s.risk)), F.lit(-1))
    high = risk_rank("High")
    put_away = (F.size("parts") <= secrets.MAX_DEPTH) & (F.greatest(top("names"), top("inside")) >= high)
    route = F.when(F.col("pruned"), "pruned")
    route = route.when(put_away, "stash") if stash else route
    route = route.when(F.size("parts") - 1 > pack_depth, "too_deep").when(top("names") >= high, "deny_name").when(top("inside") >= risk_rank(content_min), "deny_content").otherwise("pack")
    return rows.select("root", F.element_at("parts", 1).alias("project"), "path", "size_bytes", secrets.once(route).alias("route"))


def pack_stats(routed: DataFrame) -> DataFrame:
    n = lambda *r: F.count_if(F.col("route").isin(*r))
    packed = F.coalesce(F.sum(F.when(F.col("route") == "pack", F.col("size_bytes"))), F.lit(0))
    return routed.groupBy("root", "project").agg(
        n("pack").alias("file_count"), n("deny_name", "deny_content").alias("skipped_secret_files"),
        n("stash").alias("stashed"), n("pruned").alias("pruned"), packed.alias("pack_bytes"),
    )


def skipped_dirs(entries: DataFrame, policy: P.Policy = P.DEFAULT) -> DataFrame:
    """root, project, path: the outermost directories that a pack leaves out, counted from the project."""
    above = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))
    own = P.skipped(F.slice("parts", F.size("parts"), F.lit(1)), F.lit("dir"), policy)
    dirs = entries.where("kind = 'dir' and size(parts) >= 2").where(own & ~P.skipped(above, F.lit("dir"), policy))
    return dirs.select("root", F.element_at("parts", 1).alias("project"), "path")


def with_in_trash(routed: DataFrame, trash: DataFrame) -> DataFrame:
    """routed with in_trash: whether a trash directory lies above the file, by an equi join on its ancestors."""
    up = routed.select("root", "path", F.explode(P.ancestors(P.parts("path"))).alias("dir"))
    held = up.join(trash.select("root", F.col("path").alias("dir")), ["root", "dir"], "left_semi").select("root", "path").distinct()
    out = routed.join(held.withColumn("in_trash", F.lit(True)), ["root", "path"], "left")
    return out.select(*routed.columns, F.coalesce("in_trash", F.lit(False)).alias("in_trash"))


def plan_success(stages: DataFrame, *by: str) -> DataFrame:
    """root (and the columns of by), success: all enabled stages are ok; an empty stash is ok."""
    return stages.groupBy("root", *by).agg(F.bool_and("ok").alias("success"))


def lifecycle_plans(routed: DataFrame, trash: DataFrame, choices: list[tuple[bool, bool, bool]], errors: DataFrame | None = None) -> DataFrame:
    """lifecycle_stages with ok for every choice (its number as choice) of the phases stash, trash and pack, from one look at
    the files. A stage that is switched off counts nothing, is ok and says "disabled"; errors (root, stage, message) of the
    others make theirs fail and are told in the message."""
    rows = lifecycle_stages(routed, trash)
    if errors is None:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    else:
        rows = rows.join(errors.groupBy("root", "stage").agg(F.min("message").alias("error")), ["root", "stage"], "left")
    names = ("stash", "trash", "pack")
    each = [F.struct(F.lit(i).alias("choice"), F.struct(*[F.lit(bool(on)).alias(n) for n, on in zip(names, c, strict=True)]).alias("on")) for i, c in enumerate(choices)]
    rows = rows.withColumn("c", F.explode(F.array(*each)))
    on = F.coalesce(*[F.when(F.col("stage") == n, F.col("c.on")[n]) for n in names])
    rows = rows.withColumn("on", on)
    zero = lambda c: F.when(F.col("on"), F.col(c)).otherwise(0).alias(c)
    message = F.when(~F.col("on"), "disabled").otherwise(F.coalesce("error", "message"))
    ok = ~F.col("on") | F.col("error").isNull()
    return rows.select("root", F.col("c.choice").alias("choice"), "ord", "stage", zero("files"), zero("bytes"), message.alias("message"), ok.alias("ok"))


def lifecycle_plan(routed: DataFrame, trash: DataFrame, stash: bool = True, rinse: bool = True, pack: bool = True, errors: DataFrame | None = None) -> DataFrame:
    """lifecycle_plans of one choice."""
    return lifecycle_plans(routed, trash, [(stash, rinse, pack)], errors).drop("choice")


def lifecycle_stages(routed: DataFrame, trash: DataFrame) -> DataFrame:
    """root, ord, stage, files, bytes, message: stash, trash, pack."""
    s = routed.where("route = 'stash'").groupBy("root").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    t = trash.groupBy("root").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    p = routed.where("route = 'pack'").groupBy("root").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    text = {
        "stash": F.when(F.col("files") == 0, "nothing to stash").otherwise(F.format_string("would stash %d files", "files")),
        "trash": F.format_string("found %d directories", "files"),
        "pack": F.lit("would pack project"),
    }
    roots = routed.select("root").distinct()
    out = None
    for i, (stage, rows) in enumerate((("stash", s), ("trash", t), ("pack", p))):
        r = roots.join(rows, "root", "left").na.fill(0, ["files", "bytes"]).select("root", F.lit(i).alias("ord"), F.lit(stage).alias("stage"), "files", "bytes", text[stage].alias("message"))
        out = r if out is None else out.unionByName(r)
    return out
