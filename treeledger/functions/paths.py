"""Path, name and size columns. Paths are relative to their root, with / between components; the root itself is ''."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeledger.functions.rules import SKIP_EXACT, SKIP_SUFFIX


def parts(path) -> Column:
    """Components; the root has none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.filter(F.split(path, "/"), lambda x: x != "")


def join_parts(p: Column) -> Column:
    return F.array_join(p, "/")


def ancestors(p: Column) -> Column:
    """Every directory above a path, from the root '' down."""
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: join_parts(F.slice(p, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))


def is_under(p: Column, root: Column) -> Column:
    """Component-wise containment: a/b is not under a/b-c."""
    return F.slice(p, F.lit(1), F.size(root)) == root


def relative(p: Column, root: Column) -> Column:
    """The path below root; null where it is not below or holds '..'."""
    clean = F.filter(p, lambda x: x != ".")
    fits = is_under(clean, root) & ~F.exists(clean, lambda x: x == "..")
    return F.when(fits, join_parts(F.slice(clean, F.size(root) + 1, F.greatest(F.size(clean) - F.size(root), F.lit(0)))))


def resolved(path: Column) -> Column:
    """A path as a user wrote it, as components without '.', empty ones and 'x/..'. Null if it is absolute or climbs above
    its root at any point. Links are not followed."""
    up = lambda at: F.size(at.parts) > 0
    none = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("outside"))

    def step(at: Column, c: Column) -> Column:
        back = F.slice(at.parts, F.lit(1), F.greatest(F.size(at.parts) - 1, F.lit(0)))
        parts = F.when(c == "..", back).when(c.isin("", "."), at.parts).otherwise(F.concat(at.parts, F.array(c)))
        return F.struct(parts.alias("parts"), (at.outside | ((c == "..") & ~up(at))).alias("outside"))

    fold = F.array(F.aggregate(F.split(path, "/"), none, step))  # in an array, so that it is worked out once
    inside = lambda at: F.when(~(F.startswith(path, F.lit("/")) | at.outside), at.parts)
    return F.element_at(F.transform(fold, inside), 1)


def relative_name(path: Column, root: Column) -> Column:
    """The name of a path below root (components); null where it is absolute, climbs out, or isn't below root. Unlike
    relative, it takes the path as written, so that a leading / isn't lost."""


    def below(p: Column) -> Column:
        n = F.size(p) - F.size(root)
        return F.when(is_under(p, root) & (n > 0), join_parts(F.slice(p, F.size(root) + 1, F.greatest(n, F.lit(1)))))

    return F.element_at(F.transform(F.array(resolved(path)), below), 1)


def slug(s: Column) -> Column:
    """Last component, blanks to -, other characters than letters, digits, . _ - dropped, 80 at most, else project."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(s, r"[/\\]"), lambda x: x != "")), -1)
    kept = F.regexp_replace(F.regexp_replace(last, r"(?U)\s", "-"), r"[^A-Za-z0-9._-]", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 80), F.lit("")), F.lit("project"))


def dated(kind: str, name: Column, ts: Column) -> Column:
    """kind/yyyy/mm/name, with zeros for what a short timestamp lacks."""
    year = F.when(F.length(ts) < 4, F.lit("0000")).otherwise(F.substring(ts, 1, 4))
    month = F.when(F.length(ts) < 6, F.lit("00")).otherwise(F.substring(ts, 5, 2))
    return F.concat_ws("/", F.lit(kind), year, month, name)


def valid_fragment(s: Column) -> Column:
    return ~(s.isin("", ".", "..") | s.contains("/") | s.contains("\\") | s.contains("\0"))


def one_decimal(b: Column, unit: int) -> Column:
    """b / unit with one decimal, in whole numbers: an exact half goes to the even digit, as C's %.1f has it, while
    format_string takes it up."""
    n, tenth = F.abs(b.cast("long")), F.lit(10)
    over = F.pmod(n, F.lit(unit)) * tenth  # what lies above whole units, in tenths of one
    down, left = F.floor(over / F.lit(unit)).cast("long"), F.pmod(over, F.lit(unit)) * 2
    up = (left > unit) | ((left == unit) & (down % 2 == 1))
    digit = down + up.cast("long")
    whole = F.shiftright(n, unit.bit_length() - 1) + F.when(digit == tenth, 1).otherwise(0)
    return F.concat(F.when(b < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), (digit % tenth).cast("string"))


def human_size(b: Column) -> Column:
    out = F.concat(b.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(b >= 1024**k, F.concat(one_decimal(b, 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Policy:
    """Which directories a walk prunes: the default names, custom ones (a leading * stands for any start), hidden ones."""

    default: bool = True
    custom: tuple[str, ...] = ()
    hidden: bool = False


DEFAULT = Policy()
EMPTY = Policy(default=False)


def skipped_dir(name: Column, custom=(), hidden: bool = False, default: bool = True) -> Column:
    """Why a directory is pruned: DefaultDirName, CustomPattern or Hidden, else null."""
    named = name.isin(SKIP_EXACT) | F.endswith(name, F.lit(SKIP_SUFFIX)) if default else F.lit(False)
    out = F.when(named, "DefaultDirName")
    for c in custom:
        hit = F.endswith(name, F.lit(c[1:])) if c.startswith("*") else name == c
        out = out.when(hit, "CustomPattern")
    return out.when(F.startswith(name, F.lit(".")) & (F.length(name) > 1), "Hidden") if hidden else out


def skips(name: Column, policy: Policy = DEFAULT) -> Column:
    """Whether a policy prunes a directory of that name."""
    if policy == DEFAULT:
        return name.isin(SKIP_EXACT) | F.endswith(name, F.lit(SKIP_SUFFIX))
    return skipped_dir(name, policy.custom, policy.hidden, policy.default).isNotNull()


def last_where(p: Column, fits) -> Column:
    """The place, from 1, of the last component that fits; 0 if none does."""
    return F.coalesce(F.array_max(F.transform(p, lambda c, i: F.when(fits(c), i + 1).otherwise(0))), F.lit(0))


def skipped(p: Column, kind: Column, policy: Policy = DEFAULT) -> Column:
    """Whether an entry lies in (or, as a directory, is) a pruned directory. Files are never skipped by their own name."""
    dirs = F.when(kind == "dir", p).otherwise(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))
    return F.exists(dirs, lambda c: skips(c, policy))


def check_depth(depth: int) -> int:
    if depth < 1:
        raise ValueError(f"the depth must be 1 or more, not {depth}")
    return depth


def utc_stamp(at: Column) -> Column:
    """A time as yyyyMMddTHHmmssZ, in UTC whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def short_id(of: Column) -> Column:
    """Eight hexadecimal digits that stand for a value."""
    return F.substring(F.sha2(of, 256), 1, 8)


def mib_label(b: Column) -> Column:
    return F.concat(one_decimal(b, 1 << 20), F.lit(" MiB"))


def hash_preview(h: Column) -> Column:
    """The first four characters of a hash that is longer than five."""
    return F.when(F.length(h) > 5, F.concat(F.left(h, F.lit(4)), F.lit("…"))).otherwise(h)


def primary_label(labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit("-"))


def store_relative(path: Column, store: str) -> Column:
    """A path below the store's folder relative to it, any other as it is."""
    return F.when(F.startswith(path, F.lit(store + "/")), F.substr(path, F.lit(len(store) + 2))).otherwise(path)


def pack_path(slug: Column, ts: Column, name: Column | None = None) -> Column:
    """packs/yyyy/mm/ and the given name, or slug__ts.tar.zst."""
    made = F.concat(slug, F.lit("__"), ts, F.lit(".tar.zst"))
    return dated("packs", made if name is None else F.coalesce(name, made), ts)


def stash_path(slug: Column, ts: Column, token: Column) -> Column:
    """secrets/yyyy/mm/slug__token__secrets.age; a token tells runs of the same second apart."""
    return dated("secrets", F.concat(slug, F.lit("__"), token, F.lit("__secrets.age")), ts)


def manifest_path(slug: Column, ts: Column, id_: Column) -> Column:
    return dated("manifests", F.concat(slug, F.lit("__"), ts, F.lit("__"), id_, F.lit(".json")), ts)


def glob_match(name: Column, pattern: Column) -> Column:
    """*suffix or the exact name."""
    return F.when(F.startswith(pattern, F.lit("*")), F.endswith(name, F.substr(pattern, F.lit(2)))).otherwise(name == pattern)
