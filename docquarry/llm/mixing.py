"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

Targets: the sources, by code point and null last, weigh in turn as given and share a
multiple of all words; no target exceeds ``most`` times its source's words, and what is
above is shared anew by weight until none is.

A source whose target is that cap takes every word so often.  The others' words are dealt in equal
blocks of BLOCK words, twice by highest quotients votes / (2k - 1): first to the sources by their targets,
so that each is within a block or so of its own, then each source's blocks to its shards by their words.  A
shard's number of blocks is its quota; it never holds more than its words allow, the last block
being as short as they ask.  Equal quotients go by a seeded hash of the party.

Every source is dealt by hash into shards of about ROWS_PER_SHARD rows.  A shard's rows stand in seeded
random order on one line of words; the quota takes whole rounds of that line and, for what is left,
the blocks of a run from a seeded start, so that one or two texts of a shard are cut and not all.

Null texts have no words.  An empty table, or one without words, takes nothing.
Rows alike in id, source and text are interchangeable; more of them than a shard holds are numbered and
spread over the shards.  No step gathers a source's rows, or such copies, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import WORD, ensure_checkpoint_dir, numbered

#: Words of a block, rows of a shard, sources or keys that may be broadcast.
BLOCK, ROWS_PER_SHARD, BROADCAST_SOURCES = 8, 500, 10_000
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def few(rows: DataFrame) -> bool:
    """Whether a kept table is small enough to be broadcast."""
    return rows.count() <= BROADCAST_SOURCES


def apportion(parties: DataFrame) -> DataFrame:
    """Seats by highest quotients in every group: adds ``seats`` to rows of (group string, party long, votes
    double, all double, house long, cap long), where ``all`` is the group's votes, ``house`` its seats.

    With votes v in seats, rounding v / d to whole seats gives at most the house where d exceeds house /
    (house - n / 2), and at least it below house / (house + n / 2), for n parties; so only quotients
    between these, about two a party, are put in order, all groups in one distributed sort.
    Parties at their cap take no more, and where that leaves too few quotients, the lower bound falls.
    Equal quotients go by the party's number.
    """
    ensure_checkpoint_dir(parties.sparkSession)
    v = F.when(F.col("all") > 0, F.col("votes") / F.col("all") * F.col("house")).otherwise(0.0)
    parties = parties.withColumn("v", v).checkpoint()
    rounded = lambda d: F.least(F.floor(F.col("v") / d + 0.5), F.col("cap"))
    n = F.count("*") / 2 + 1
    house = F.first("house")
    groups = parties.groupBy("group").agg(
        F.least(house, F.sum("cap")).alias("want"),
        (F.greatest(house, F.lit(1)) / (house + n)).alias("low"),
        F.when(house > n, house / (house - n)).alias("high"),
    ).checkpoint()
    small = few(groups)

    def bounded() -> DataFrame:
        own = F.broadcast(groups) if small else groups
        base = F.when(F.col("high").isNull(), 0).otherwise(rounded(F.col("high")))
        return parties.join(own, "group").withColumn("base", base).withColumn("top", F.greatest(rounded(F.col("low")), "base"))

    while True:
        lacking = bounded().groupBy("group", "want", "low", "high").agg(F.sum("top").alias("top"), F.sum("base").alias("base"))
        lacking = lacking.withColumn("lacks", F.col("top") < F.col("want")).checkpoint()
        if lacking.where("lacks").isEmpty():
            break
        groups = lacking.select("group", "want", F.when(F.col("lacks"), F.col("low") / 2).otherwise(F.col("low")).alias("low"), "high").checkpoint()
    placed = bounded()
    offers = placed.where("top > base").select("group", "party", "votes", F.explode(F.sequence(F.col("base") + 1, F.col("top"))).alias("seat"))
    # of the votes as given, so that equal quotients are equal numbers
    quotient = F.col("votes") / (2 * F.col("seat") - 1)
    ranked = numbered(offers.select("group", "party", "seat", quotient.alias("quotient")), [F.col("group"), F.col("quotient").desc(), F.col("party"), F.col("seat")], "place")
    first = ranked.groupBy("group").agg(F.min("place").alias("first"))
    limits = lacking.select("group", (F.col("want") - F.col("base")).alias("left")).join(F.broadcast(first) if small else first, "group")
    won = ranked.join(F.broadcast(limits) if small else limits, "group").where(F.col("place") - F.col("first") < F.col("left"))
    more = won.groupBy("group", "party").agg(F.count("*").alias("more"))
    return placed.join(more, ["group", "party"], "left").withColumn("seats", F.col("base") + F.coalesce("more", F.lit(0))).drop("v", "want", "low", "high", "base", "top", "more")


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rows, source_size, target) from rows of (source, size)."""
    ensure_checkpoint_dir(sizes.sparkSession)
    totals = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    placed = numbered(totals, [F.col("source").asc_nulls_last()], "place")
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = placed.select("source", "rows", "source_size", w.alias("weight")).checkpoint()
    cap = F.col("source_size") * most
    words = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while words:
        above = F.col("weight") * level > cap
        rest, free, n = weighed.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("long"))).first()
        if n == full or not free:
            break
        level, full = (share * words - rest) / free, n
    return weighed.select("source", "rows", "source_size", F.least(F.col("weight") * level, cap).alias("target"))


def mix(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 42, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each row: a struct ``row`` of the carried columns, and size,
    source_size, target, rounds (whole copies), begin and end (the words, from 0 and
    exclusive, that are taken once more), taken."""
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = F.xxhash64(F.lit(seed), F.col(id_col), text)
    # a name of the source that is never null
    of = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    rows = docs.select(F.struct(*carry).alias("row"), F.col(source_col).alias("source"), of.alias("group"), words_of(F.col(text_col)).alias("size"), spread.alias("spread"))
    slim = rows.select("source", "group", "size", "spread").checkpoint()
    totals = targets(slim, weights, share, most).withColumn("group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source").checkpoint()
    small = few(totals)
    copies = slim.groupBy("group", "spread", "size").count().where(F.col("count") > ROWS_PER_SHARD).drop("count").checkpoint()
    some = not copies.isEmpty()
    small_copies = some and few(copies)

    def counted(df: DataFrame) -> DataFrame:
        """The rows with the place of each among more copies than a shard holds, by parts of a shard."""
        if not some:
            return df.withColumn("part", F.lit(0))
        key = ["group", "spread", "size"]
        keys = F.broadcast(copies) if small_copies else copies
        placed = numbered(df.join(keys, key, "left_semi"), [*map(F.col, key), F.rand(seed)], "place")
        first = placed.groupBy(*key).agg(F.min("place").alias("first"))
        parts = placed.join(F.broadcast(first) if small_copies else first, key).withColumn("part", F.floor((F.col("place") - F.col("first")) / F.lit(max(1, ROWS_PER_SHARD // 4))).cast("int"))
        return df.join(keys, key, "left_anti").withColumn("part", F.lit(0)).unionByName(parts.select(*df.columns, "part"))

    def dealt(df: DataFrame) -> DataFrame:
        """The rows with their source's figures and their shard."""
        joined = counted(df).join(F.broadcast(totals) if small else totals, "group")
        shards = F.ceil(F.col("rows") / ROWS_PER_SHARD)
        return joined.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("spread"), F.col("part")), shards)).drop("rows")

    full = F.col("target") >= F.col("source_size") * most
    parties = dealt(slim).groupBy("group", "shard", "source_size", "target").agg(F.sum("size").alias("line")).withColumn("cap", F.ceil(F.col("line") * most / block)).checkpoint()
    sources = parties.where(~full).groupBy("group", "target").agg(F.sum("cap").alias("cap")).checkpoint()
    # rounded, so that the order of the sum has no part in it
    wanted = round(sources.agg(F.sum("target")).first()[0] or 0.0, 4)
    house = int(wanted / block + 0.5)
    one = sources.select(F.lit("").alias("group"), F.xxhash64(F.lit(seed), F.col("group")).alias("party"), F.col("group").alias("of"), F.col("target").alias("votes"), F.lit(wanted).alias("all"), F.lit(house).cast("long").alias("house"), "cap")
    blocks = apportion(one).select(F.col("of").alias("group"), F.col("seats").alias("house")).checkpoint()
    inner = parties.where(~full).join(F.broadcast(blocks) if small else blocks, "group")
    inner = inner.select("group", "shard", F.xxhash64(F.lit(seed), F.col("group"), F.col("shard")).alias("party"), F.col("line").cast("double").alias("votes"), F.col("source_size").cast("double").alias("all"), "house", "cap")
    quotas = apportion(inner).select("group", "shard", "seats").checkpoint()

    line = Window.partitionBy("group", "shard")
    before = line.orderBy("spread", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt(rows).withColumn("line", F.sum("size").over(line)).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.join(F.broadcast(quotas) if few(quotas) else quotas, ["group", "shard"], "left")
    most_words = F.floor(F.col("line") * most)
    quota = F.when(full, most_words).otherwise(F.least(F.coalesce("seats", F.lit(0)) * block, most_words)).cast("long")
    placed = placed.withColumn("words", quota).withColumn("rounds", F.when(F.col("line") > 0, F.floor(F.col("words") / F.col("line"))).otherwise(0).cast("long"))
    left = F.col("words") - F.col("rounds") * F.col("line")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("group"), F.col("shard")), F.floor((F.col("line") - left) / block) + 1) * block
    placed = placed.withColumn("from", start).withColumn("upto", F.col("from") + left)
    inside = lambda x: F.least(F.greatest(x - F.col("at"), F.lit(0)), F.col("size")).cast("long")
    placed = placed.withColumn("begin", inside(F.col("from"))).withColumn("end", inside(F.col("upto")))
    return placed.select("row", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "rounds", "begin", "end", (F.col("rounds") * F.col("size") + F.col("end") - F.col("begin")).alias("taken"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """(id, size, source_size, target, taken)."""
    return mix(docs, [id_col], id_col=id_col, **settings).select(F.col(f"row.{id_col}").alias(id_col), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **settings) -> DataFrame:
    """The mixture itself, with the input's columns: a row for every whole copy, and a row
    with the words taken once more where that is part of a text.  Rows not taken go."""
    mixed = mix(docs, docs.columns, text_col=text_col, **settings)
    # a word with the blanks after it; blanks before the first word go with it
    pieces = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(rf"([\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    part = F.array_join(F.slice(pieces, (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")), "")
    whole = F.when(F.col("size") > 0, F.col("rounds") + (F.col("end") - F.col("begin") == F.col("size")).cast("long")).otherwise(0)
    cut = (F.col("end") > F.col("begin")) & (F.col("end") - F.col("begin") < F.col("size"))
    copies = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    taken = mixed.withColumn("cut", F.explode(copies))
    text = F.when(F.col("cut"), part).otherwise(F.col(f"row.{text_col}"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: text}
    if length_col in docs.columns:
        columns[length_col] = F.when(F.col("cut"), F.length(part)).otherwise(F.col(f"row.{length_col}")).cast(docs.schema[length_col].dataType)
    return taken.select(*(v.alias(k) for k, v in columns.items()))
