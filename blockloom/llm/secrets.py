"""Secret scan (operator 10): DataFrame functions only.

Base patterns find assignments, access keys and hexadecimal runs. Besides, every run of 20 or
more credential characters with a letter and a digit is a candidate. Corpus-wide ownership
frequency decides on candidates: the hashes are aggregated by distinct repositories and owners. A
value that at most MAX_OWNERS owners have, in at most MAX_REPOS of their repositories, looks live and becomes a span of kind ``owned``; a value
that several owners copy, or one owner through many repositories, is an example and adds none. Base spans always stay.

A match's place is the sum of the lengths before it: matches become rows, and one running sum for each text and kind gives
all places, so the work is linear in the matches of a text.

Null text counts as empty, a null owner or repository as one more, unnamed one. Repeated rows are
scanned alike, each with its own result. An empty table gives no rows. Texts are never cut.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, materialize, text_of

# The patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run that fails its least length has no part that passes, so the length can stand in the pattern.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
OWNED_LONG = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
MAX_OWNERS = 1
#: A repository is, unless told otherwise, what one source has in one language.
MAX_REPOS = 3


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as array<struct>: their kind and number, the length of what lies before each (since the last), their own, and what decides on them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    of_pattern = F.struct(whole.alias("w"), (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length) if kind == 0 else F.array().cast("array<int>")).alias("v"), F.transform(F.split(text, pattern, -1), F.length).alias("b"))

    def rows(p: Column) -> Column:
        holds = {0: lambda m, i: F.element_at(p["v"], i + 1) >= 6, 3: lambda m, i: m.rlike("[0-9]") & m.rlike("[A-Za-z]")}.get(kind, lambda m, i: F.lit(True))
        return F.transform(
            p["w"],
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.element_at(p["b"], i + 1).alias("before"),
                F.length(m).alias("size"),
                holds(m, i).alias("holds"),
                (F.sha2(m.cast("binary"), 256) if kind == 3 else F.lit(None).cast("string")).alias("hash"),
            ),
        )

    none = F.array().cast("array<struct<kind:int,i:int,before:int,size:int,holds:boolean,hash:string>>")
    # transform() over an array of one binds the struct once, so no pattern runs twice
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(of_pattern), rows))).otherwise(none)


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """One row for each input row: rid, doc_id, owner, repo, matches (of all kinds)."""
    own = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        text_of(text_col).alias("text"),
    )
    matches = F.concat(*[_matches(F.col("text"), p, k) for k, p in enumerate((ASSIGN, ACCESS_LONG, HEX_LONG, OWNED_LONG))])
    return own.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", matches.alias("matches"))


def spans_of(found: DataFrame) -> DataFrame:
    """rid, owner, repo, kind, start, end, hash of every match that holds."""
    rows = found.where(F.size("matches") > 0).select("rid", "owner", "repo", F.inline("matches"))
    # a match ends where the sum of all that lies between and of all matches up to it says
    end = F.sum(F.col("before").cast("long") + F.col("size")).over(Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).where("holds").select("rid", "owner", "repo", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of every candidate value; a hot value is combined before each shuffle."""
    repos = spans.where("kind = 3").groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_owned, base_sha256, spans of every row."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    found = materialize(candidates(docs, id_col, text_col, owner, repo), "secrets")
    spans = materialize(spans_of(found), "secret-spans")
    freq = materialize(ownership(spans), "ownership")
    live = freq.where((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).select("hash")
    place = F.struct("start", "kind", "end")
    base = spans.where("kind < 3").select("rid", place.alias("s"))
    owned = spans.where("kind = 3").join(live, "hash").select("rid", place.alias("s"))
    of = base.unionByName(owned).groupBy("rid").agg(F.collect_list("s").alias("all"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = found.select("rid", "doc_id").join(of, "rid", "left").withColumn("all", F.coalesce("all", none))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    out = out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("all", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        count(3).alias("n_owned"),
    )
    out = materialize(out, "secret-rows")
    discard(found, spans, freq)
    return out
