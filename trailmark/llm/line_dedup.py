"""Line dedup by distinct-site spread, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import materialise

#: A line of at least so many words that at least so many sites share is boilerplate.
MIN_WORDS, MIN_SITES = 6, 5
#: log2 of the HyperLogLog registers. Estimates within NEAR of the threshold (as a share of it; over ten standard
#: errors) are replaced by exact distinct counts.
LG_REGISTERS, NEAR = 12, 0.25
#: Parts that the places of one line are dealt over, so that a line that a third of all documents share meets its
#: verdict in many tasks. Each verdict is copied so often.
SALTS = 32


def normal_line(line: Column) -> Column:
    return F.trim(line)


def digest(text: Column) -> Column:
    """128 bits, as 64 would let two of 10^10 lines or texts meet."""
    return F.unhex(F.md5(text.cast("binary")))


def n_words(line: Column) -> Column:
    """Runs of other than spaces; 1 for a line without."""
    line = normal_line(line)
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(F.contains(line, F.lit("  ")), F.size(F.split(line, " +"))).otherwise(spaces + 1).cast("int")


def places_of_lines(rows: DataFrame, min_words: int) -> DataFrame:
    """text_key, id, site, line_key, pos, words: one row for each long line of each text of rows (id, site, text)."""
    lines = rows.where("text is not null").select(digest(F.col("text")).alias("text_key"), "id", F.col("site").cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("words", n_words(F.col("line"))).where(F.col("words") >= min_words)
    return lines.select("text_key", "id", "site", digest(normal_line(F.col("line"))).alias("line_key"), "pos", "words")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line_key, sites, first_id (the least id that has it) of the lines that at least min_sites sites share.

    Sketches merge by aggregation, partly before the shuffle, so a line that a third of all documents share costs each
    task one row. Lines near the threshold get an exact count; their (line, site) pairs are made distinct before they
    meet the list of such lines, so that none has more rows than sites. Null sites count for none.
    """
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)))
    seen = lines.groupBy("line_key").agg(F.count("*").alias("n"), sketch.alias("estimate"), F.min("id").alias("first_id"))
    # Seen fewer times than min_sites, a line can't have as many sites.
    sketched = materialise(seen.where((F.col("n") >= min_sites) & (F.col("estimate") >= min_sites * (1 - NEAR))), "sketched-lines")
    close = F.col("estimate") <= min_sites * (1 + NEAR)
    pairs = lines.where("site is not null").groupBy("line_key", "site").agg(F.lit(1).alias("one"))
    exact = pairs.join(sketched.where(close).select("line_key"), "line_key", "left_semi").groupBy("line_key").agg(F.count("*").alias("exact"))
    judged = sketched.join(exact, "line_key", "left").withColumn("sites", F.when(close, F.coalesce("exact", F.lit(0))).otherwise(F.col("estimate")))
    return materialise(judged.where(F.col("sites") >= min_sites).select("line_key", "sites", "first_id"), "boilerplate-lines")


def places_to_cut(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """Places of boilerplate lines with first_id, but for those of the first document. Places are dealt over SALTS."""
    salted = spread.select("line_key", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = lines.withColumn("salt", F.pmod(F.xxhash64("text_key", "id"), F.lit(SALTS)).cast("int")).join(salted, ["line_key", "salt"])
    return found.where(~F.col("id").eqNullSafe(F.col("first_id")) | F.col("id").isNull())


def cuts(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """text_key, id, cut (places of lines): what each text loses."""
    return places_to_cut(lines, spread).groupBy("text_key", "id").agg(F.collect_set("pos").alias("cut"))


def cuts_of_copies(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """text_key, id, cut, copied, copied_words: also the places of those lines of each text that the one first document
    keeps with which it shares most words, and their words, where these are half of the words of that document's long
    lines at least."""
    own = lines.join(spread.select(F.col("first_id").alias("id")).where("id is not null").distinct(), "id", "left_semi")
    own = own.groupBy("id", "text_key", "line_key").agg(F.max("words").alias("words")).groupBy("id", "text_key").agg(F.sum("words").alias("words"))
    own = own.groupBy(F.col("id").alias("first_id")).agg(F.min("words").alias("first_words"))
    found = places_to_cut(lines, spread).groupBy("text_key", "id", "first_id").agg(F.collect_set(F.struct("line_key", "words")).alias("shared"), F.collect_set("pos").alias("places"))
    shared = found.withColumn("n", F.aggregate("shared", F.lit(0), lambda n, x: n + x["words"])).join(own, "first_id", "left")
    best = F.max(F.when(2 * F.col("n") >= F.col("first_words"), F.struct("n", "first_id", "places")))
    made = shared.groupBy("text_key", "id").agg(F.flatten(F.collect_list("places")).alias("cut"), best.alias("best"))
    return made.select("text_key", "id", "cut", F.coalesce("best.places", F.array().cast("array<int>")).alias("copied"), F.coalesce("best.n", F.lit(0)).alias("copied_words"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", spare_copies: bool = False) -> DataFrame:
    """Remove lines that at least min_sites distinct sites share, but for the document with the least id that has them.

    Returns all rows and columns of docs with the text cut, and n_lines and n_removed (long); columns of docs with these
    two names give way, all others stay, however they are named. Lines are what \\n parts; they are compared without
    outer spaces; shorter ones than min_words words stay. The first document keeps its copies, so that content that is
    copied across sites is not lost everywhere; where all ids are null, none does. Null texts stay null with 0 lines; an
    empty text has one line. Repeated rows are treated alike. No rows: no rows.

    spare_copies leaves copies comparable with their originals: where the lines that one first document keeps are half of
    the words of a text's long lines and of its own, the text keeps them too; and a text that would lose all its long
    lines, but not all its text, stays whole. Which of these are near duplicates is for others to judge.

    What is cut is a list of places for each text, found on a narrow table of lines; texts meet their lists in one
    shuffle join, the same at every size, so that growth holds no change of plan.
    """
    # The user's columns travel in one struct, so that no name can clash with an inner one.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{site_col}`").alias("site"), F.col(f"`{text_col}`").alias("text"))
    lines = materialise(places_of_lines(rows, min_words), "lines")
    spread = boilerplate(lines, min_sites)
    hit = cuts_of_copies(lines, spread) if spare_copies else cuts(lines, spread)
    # As lines are cut alike wherever id and text are the same, these two identify what to change.
    hit = hit.withColumn("id_key", F.xxhash64("id")).drop("id")
    keyed = rows.select("row", "text", digest(F.col("text")).alias("text_key"), F.xxhash64("id").alias("id_key"))
    joined = keyed.join(hit.hint("merge"), ["text_key", "id_key"], "left")
    parts = F.split("text", "\n")

    def without(cut: Column) -> Column:
        return F.filter(parts, lambda x, i: ~F.array_contains(cut, i))

    kept = without(F.col("cut"))
    if spare_copies:
        long_lines = F.array_distinct(F.transform(F.filter(parts, lambda x: n_words(x) >= min_words), normal_line))
        all_words = F.aggregate(long_lines, F.lit(0), lambda n, x: n + n_words(x))
        is_copy, blank = 2 * F.col("copied_words") >= all_words, F.trim(F.array_join(kept, "\n")) == ""
        bare = ~F.exists(kept, lambda x: n_words(x) >= min_words)
        kept = F.when(blank, kept).when(is_copy, without(F.array_except("cut", "copied"))).when(bare, parts).otherwise(kept)
    made = joined.select("row", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.when(F.col("cut").isNotNull(), kept).alias("kept"))
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long")
    cut = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    columns = [cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return made.select(*columns, "n_lines", removed.alias("n_removed"))
