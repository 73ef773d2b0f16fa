"""Line dedup by a log-template tree, in DataFrame functions only.

A line descends a tree of fixed depth: token count, then its LEADING first
tokens with digit runs masked, then its tokens at the two places of each of
BRANCHES branches, so a leaf has several templates.  A branch's template is its
first line (smallest document, then place); a line follows it when at least
SIMILAR of all tokens, and half of those after the leading ones, agree place by
place (the others are the variable fields).  Equal lines always follow their
first one.  A template found in at least ``min_docs`` documents recurs: its
lines are dropped from all documents but its first.

A line that shares all but a share v of its tokens with a template misses it with
probability (1 - (1 - v)**2)**BRANCHES at most: 0.00001 at v = 1/8, 0.005 at 0.3.
Tokens are compared as 16-bit hashes, one by one, so the agreement of two lines
is overstated by one in 65,536 of their differing tokens; unlike lines can't pass.

Lines of fewer than ``min_tokens`` tokens are left alone, and lines that occur
in one document only are no recurrence.

Defined cases: a null text stays null with 0 lines; an empty text is one empty
line and stays; documents with a null id keep all lines; rows that share an id
count as one document and lose the same line numbers; columns pass through
whatever their names, only n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltybench.llm.storage import stored, unused

LEADING, BRANCHES, SIMILAR = 3, 8, 0.7
MIN_DOCS, MIN_TOKENS = 2, 4
#: What a digit run becomes.
MASK = "<*>"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, place, leaf, form and tokens (16-bit hashes) of each line that may recur."""
    cut = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    # Enough spaces for min_tokens: the test costs no split, and none is repeated by pushing it down.
    long = cut.withColumn("line", F.trim("line")).where(F.substring_index("line", " ", min_tokens - 1) != F.col("line")) if min_tokens > 1 else cut.withColumn("line", F.trim("line"))
    masked = long.select("doc", "place", F.regexp_replace("line", "[0-9]+", MASK).alias("line"))
    # Tokens are a column of their own, used twice, so that they are cut once a line.
    tokens = masked.withColumn("tokens", F.split("line", " "))
    return tokens.select(
        "doc",
        "place",
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)).alias("leaf"),
        F.xxhash64("line", F.lit(1)).alias("form"),
        F.transform("tokens", lambda t: (F.hash(t).bitwiseAND(0xFFFF) - 0x8000).cast("smallint")).alias("tokens"),
    )


def branch_places(b: int) -> tuple[float, float]:
    """Where a branch looks, as shares of the tokens after the leading ones: each of BRANCHES parts twice in all."""
    return (b + 0.5) / BRANCHES, ((3 * b + 1) % BRANCHES + 0.5) / BRANCHES


def _branches(leaf: Column, tokens: Column) -> Column:
    rest = F.greatest(F.size(tokens) - LEADING, F.lit(1))

    def at(share: float) -> Column:
        return F.get(tokens, F.least(F.floor(rest * share) + LEADING, F.size(tokens) - 1).cast("int"))

    return F.array(*[F.xxhash64(leaf, F.lit(b), *[at(share) for share in branch_places(b)]) for b in range(BRANCHES)])


def _follows(line: Column, template: Column) -> Column:
    n = F.size(line)
    same = F.size(F.filter(F.zip_with(line, template, lambda a, b: a == b), lambda x: x))
    least = F.greatest(F.ceil(F.lit(SIMILAR) * n), F.least(F.lit(LEADING), n) + F.ceil((n - LEADING) / 2))
    return (F.size(template) == n) & (same >= least)


def followers(found: DataFrame) -> DataFrame:
    """(form, template) of masked lines that follow the first line of one of their branches; templates are forms too.

    Only leaves with several forms in several documents can have one that matters.
    """
    shared = found.groupBy("leaf").agg(F.min("form").alias("f1"), F.max("form").alias("f2"), F.min("doc").alias("d1"), F.max("doc").alias("d2")).where("f1 <> f2 and d1 <> d2").select("leaf")
    # These sides grow with the corpus, so they are merged at every size and never broadcast.
    # Joins end in a written table: a hot leaf or template is then split over tasks, and summed in part before any shuffle.
    several = stored(found.join(stored(shared, "leaves").hint("merge"), "leaf", "left_semi"), "several")
    forms = stored(several.groupBy("leaf", "form").agg(F.min(F.struct("doc", "place")).alias("first"), F.first("tokens").alias("tokens")), "forms")
    branches = forms.select("form", "first", F.explode(_branches(F.col("leaf"), F.col("tokens"))).alias("branch"))
    opening = branches.groupBy("branch").agg(F.min(F.struct("first", "form")).alias("opening"), F.max("form").alias("f1"), F.min("form").alias("f2")).where("f1 <> f2")
    opening = stored(opening.select("branch", F.col("opening.form").alias("template")), "openings")
    pairs = stored(branches.select("form", "branch").join(opening.hint("merge"), "branch").where("form <> template").select("form", "template").distinct(), "pairs")
    tokens = forms.select("form", "tokens")
    both = pairs.join(tokens.hint("merge"), "form").join(tokens.toDF("template", "opening").hint("merge"), "template")
    return both.where(_follows(F.col("tokens"), F.col("opening"))).select("form", "template")


def recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc, place, template, docs, first_doc) of each line and template of its that recurs across documents."""
    found = stored(lines(docs, key, text, min_tokens), "lines")
    follows = stored(followers(found), "follows")
    own = follows.select(F.col("template").alias("form")).distinct().withColumn("template", F.col("form"))
    follows = follows.union(own)
    placed = found.select("doc", "place", "form")
    # Equal lines: known by their first and last document before anything is counted.
    equal = placed.groupBy("form").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2")).where("d1 <> d2").select("form", F.col("form").alias("template"))
    templates = stored(follows.union(equal).distinct(), "templates")
    placed = stored(placed.join(templates.hint("merge"), "form").select("doc", "place", "template"), "placed")
    counted = placed.groupBy("template").agg(F.countDistinct("doc").alias("docs"), F.min("doc").alias("first_doc")).where(F.col("docs") >= min_docs)
    return stored(placed.join(stored(counted, "counted").hint("merge"), "template"), "recurring")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and n_lines, n_dropped; columns of these names are replaced."""
    doc, places = unused("doc", docs.columns), unused("places", docs.columns)
    found = recurring(docs, key, text, min_docs, min_tokens).where("doc > first_doc")
    dropped = found.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("place").alias(places))
    kept = docs.drop("n_lines", "n_dropped")
    joined = kept.join(dropped.hint("merge"), kept[key] == F.col(doc), "left")
    cut = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(places))
    rest = F.array_join(F.transform(left, lambda i: F.get(cut, i)), "\n")
    columns = [F.when(F.col(places).isNull(), F.col(c)).otherwise(rest).alias(c) if c == text else F.col(c) for c in kept.columns]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(cut)).cast("long")
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars_left, text_sha256 of the remaining text."""
    left = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return left.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` without recurring lines; documents that lose all their lines go, all others stay."""
    lines, dropped = unused("n_lines", docs.columns), unused("n_dropped", docs.columns)
    left = dedup(docs.withColumnsRenamed({"n_lines": lines, "n_dropped": dropped}))
    return left.where("n_dropped = 0 or n_dropped < n_lines").drop("n_lines", "n_dropped").withColumnsRenamed({lines: "n_lines", dropped: "n_dropped"}).select(*docs.columns)
