"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns in each whole text.  The hash of a candidate's value is counted over
the corpus by distinct repositories and distinct owners.  Values that many owners or many repositories
have are copied examples; those of few look live.  Tokens of mixed letters and digits become spans of
their own (kind ``owned``) if they are owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Kinds in the order of the digest: pattern, group of the value, least length of the value.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "owned": (r"[A-Za-z0-9+/_-]+", 0, 20),
}
#: What a text must have for a kind to be looked for: the same matches, found without keeping short ones.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "owned": r"[A-Za-z0-9+/_-]{20,}"}
#: A value of more owners, or of more repositories (of whatever owners), is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 10
#: Matches that are placed one after the other; longer lists are placed in parts, which are then shifted.
PART = 1024


def matches(text: Column, kind: str) -> Column:
    """Array of ``gap, size, h`` of all of a kind's leftmost matches: code points before it, its own, and the value's hash (null for one that doesn't count)."""
    pattern, group, least = KINDS[kind]
    # runs of one class: a run long enough is a match of the narrower pattern, with the same ends
    pattern = LONG.get(kind, pattern)
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def counted(x: Column) -> Column:
        keep = F.length(x) >= least
        if kind == "owned":
            keep = keep & x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
        return F.when(keep, F.sha2(x.cast("binary"), 256))

    each = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(whole)), lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size"), F.transform(value, counted).alias("h"))
    return F.when(text.rlike(pattern), each)


def placed(each: Column, k: int) -> Column:
    """Array of ``start, kind, end, h`` (code points, end exclusive) of the matches that count; *each* is a stored column.

    Match *i* begins after the gaps up to it and the matches before it.  Lists grow by copies, so no fold is
    longer than a part; parts are placed by themselves and then shifted.  As *each* is looked at once for every
    part, it mustn't be an expression that would be computed again.
    """
    empty = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,h:string>>)")

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        new = F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + x["size"]).alias("end"), x["h"].alias("h"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["h"].isNotNull(), F.concat(done["found"], F.array(new))).otherwise(done["found"]).alias("found"))

    none = F.struct(F.lit(0).alias("at"), F.coalesce(F.lit(None).cast("array<struct<start:int,kind:int,end:int,h:string>>"), empty).alias("found"))
    part = F.transform(F.sequence(F.lit(0), ((F.size(each) - 1) / PART).cast("int")), lambda n: F.struct(n.alias("n"), F.aggregate(F.slice(each, n * PART + 1, PART), none, add).alias("of")))
    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<array<struct<start:int,kind:int,end:int,h:string>>>)").alias("all"))

    def shift(done: Column, x: Column) -> Column:
        moved = F.transform(x["of"]["found"], lambda y: F.struct((y["start"] + done["at"]).alias("start"), y["kind"].alias("kind"), (y["end"] + done["at"]).alias("end"), y["h"].alias("h")))
        return F.struct((done["at"] + x["of"]["at"]).alias("at"), F.concat(done["all"], F.array(moved)).alias("all"))

    return F.when(F.size(each) > 0, F.flatten(F.aggregate(part, begin, shift, lambda done: done["all"]))).otherwise(empty)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``doc_id``, counts and digest of base spans, all ``spans``, and ``n_copied``, ``n_live`` (base spans by ownership) for each row of *docs*.

    A null or empty text has no spans.  A null repository or owner isn't counted; a value without any is
    owner-specific.  Repeated rows, and rows that share an id, are rows of their own.  Other columns aren't read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))

    listed = shared.stored(docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("bigint").alias("doc_id"), docs[repo_col].cast("string").alias("repo"), docs[owner_col].cast("string").alias("owner"), *(matches(text, kind).alias(f"m{k}") for k, kind in enumerate(KINDS))))
    found = shared.stored(listed.select("row", "doc_id", "repo", "owner", F.concat(*(placed(F.col(f"m{k}"), k) for k in range(len(KINDS)))).alias("spans")))
    each = found.where(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    # distinct pairs, then counts: both combine before they shuffle
    repos = each.where("repo IS NOT NULL").groupBy("h", "repo").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("repos"))
    owners = each.where("owner IS NOT NULL").groupBy("h", "owner").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("owners"))
    frequency = shared.stored(repos.join(owners, "h", "full_outer").select("h", F.coalesce("repos", F.lit(0)).alias("repos"), F.coalesce("owners", F.lit(0)).alias("owners")))
    copied = (F.coalesce("owners", F.lit(0)) > max_owners) | (F.coalesce("repos", F.lit(0)) > max_repos)
    known = each.join(frequency, "h", "left").select("row", "start", "kind", "end", copied.alias("copied"))
    base, live = F.col("kind") < 3, ~F.col("copied")
    span = F.struct("start", "kind", "end")
    of_row = known.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{kind}") for k, kind in enumerate(KINDS) if k < 3),
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(base | live, span)).alias("all"),
        F.count_if(base & ~live).alias("n_copied"),
        F.count_if(base & live).alias("n_live"),
    )
    out = found.select("row", "doc_id").join(of_row, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    text_of = [F.coalesce(_joined(F.col(c)), F.lit("")) for c in ("base", "all")]
    return out.select("doc_id", *zero, F.sha2(text_of[0].cast("binary"), 256).alias("base_sha256"), text_of[1].alias("spans"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_copied", "n_live")))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all of ``documents``: a document is a repository, a source an owner."""
    return scan(shared.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, source, 0 AS kind, 'assign' AS name, 6 AS least,
    regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS w,
    regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
    string_split_regex(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM d
  UNION ALL SELECT doc_id, source, 1, 'access', 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, source, 2, 'hex', 24, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, source, 3, 'owned', 20, regexp_extract_all(t, '[A-Za-z0-9+/_-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_-]+'), string_split_regex(t, '[A-Za-z0-9+/_-]+') FROM d),
e AS (SELECT doc_id, source, kind, name, least, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(v) AS v, unnest(g[1:len(w)]) AS g FROM m WHERE len(w) > 0),
s AS (SELECT *, (sum(length(g)) OVER o + sum(length(w)) OVER o)::BIGINT AS stop FROM e WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
f AS (SELECT *, stop - length(w) AS start FROM s WHERE length(v) >= least AND (kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))),
o AS (SELECT v, count(DISTINCT source) > 2 OR count(DISTINCT doc_id) > 10 AS copied FROM f GROUP BY v),
k AS (SELECT f.*, copied, name || ':' || start || ':' || stop AS span FROM f JOIN o ON f.v = o.v),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR NOT copied) AS spans,
  count(*) FILTER (kind < 3 AND copied) AS n_copied, count(*) FILTER (kind < 3 AND NOT copied) AS n_live FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN a USING (doc_id)
"""
