"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, by column
expressions alone.

A fingerprint has CELLS cells.  Every distinct paragraph adds its 64-bit digest to one cell of each
of TABLES tables: a cell keeps how many came, the XOR of their digests and the XOR of their checks.
A paragraph ends with the text's own characters: SHORTEST characters on at least, at the first line end or the
first place where CUT matches, so that short lines are taken together and long ones are cut.  Words put into a text
change the paragraphs around them, and those after are found again.  Subtracting two versions' cells cancels what they share;
peeling then recovers the digests of the paragraphs that only one of them has, from cells that
hold one alone.  Where the differences are too many for the cells, the sketch is retried larger: the
paragraphs are dealt over up to FAN sketches, and each that fails is dealt again, with other hashes; too large ones are
dealt on without a try.  What RETRIES such rounds leave, if anything, is compared as sets.

Likeness is the share of common paragraphs among all of two versions, 1 for two without any.
Null texts count as empty.  Rows alike in id and text are one document with one
successor; null ids come last.  The work follows the number n of paragraphs: n * log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import ensure_checkpoint_dir, let, numbered

TABLES, PLACES = 4, 8
CELLS = TABLES * PLACES
#: Cells of a table, paragraphs, and paragraphs at most, of one sketch of a retry.
RETRY_PLACES, LOAD, MOST_LOAD = 4, 6, 24
#: Sketches that one is dealt over at most, rounds of peeling (a fold copies its state at each), first and in a retry, rounds of retrying.
FAN, ROUNDS, RETRY_ROUNDS, RETRIES = 16, 8, 4, 16
#: Characters of a paragraph at least, and where a long line is cut: after three characters of a quarter of all.
SHORTEST = 96
_ASCII = "".join(rf"\x{c:02x}" for c in (0x20, *range(0x21, 0x7F, 4)))
_OTHERS = "".join(rf"\u{c:04x}-\u{c + 15:04x}" for c in range(0x80, 0x800, 64)) + "".join(rf"\u{c:04x}-\u{c + 1023:04x}" for c in range(0x800, 0xD800, 4096))
CUT = f"(?:[{_ASCII}]|[\\x80-\\uffff&&[{_OTHERS}]]){{3}}"
_CELL = "struct<n:int,k:bigint,x:bigint>"


def digests(text: Column) -> Column:
    """array<long>: the distinct paragraphs' digests."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{{SHORTEST},}}?(?:\\n|{CUT})|.+"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _item(digest: Column, seed: Column, places: int = PLACES) -> Column:
    """A digest with the bits of its cells and its check."""

    def parts(h: Column) -> Column:
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.shiftrightunsigned(h, 3 * t).bitwiseAND(F.lit(places - 1)) + places * t).cast("int"))
        bits = bit(0)
        for t in range(1, TABLES):
            bits = bits.bitwiseOR(bit(t))
        return F.struct(digest.alias("k"), bits.alias("bits"), F.shiftrightunsigned(h, 3 * TABLES + 4).bitwiseAND(F.lit((1 << 32) - 1)).alias("x"))

    return let(F.xxhash64(seed, digest), parts)


def _cell(n: Column, k: Column, x: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("bigint").alias("k"), x.cast("bigint").alias("x"))


def _all_bits(places: int) -> Column:
    return F.array(*(F.lit(1 << i).cast("bigint") for i in range(TABLES * places)))


def sketch(paragraphs: Column, seed: Column, places: int = PLACES) -> Column:
    """array<cell>: the cells of a set of digests."""

    def cells(items: Column) -> Column:
        zero = F.lit(0).cast("bigint")

        def cell(own: Column) -> Column:
            fold = lambda k: F.aggregate(own, zero, lambda a, i: a.bitwiseXOR(i[k]))
            return _cell(F.size(own), fold("k"), fold("x"))

        return F.transform(F.transform(_all_bits(places), lambda b: F.filter(items, lambda i: i["bits"].bitwiseAND(b) != 0)), cell)

    return let(F.transform(paragraphs, lambda d: _item(d, seed, places)), cells)


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: _cell(a["n"] - b["n"], a["k"].bitwiseXOR(b["k"]), a["x"].bitwiseXOR(b["x"])))


def peel(cells: Column, seed: Column, places: int = PLACES, rounds: int = ROUNDS) -> Column:
    """struct(found array<struct<n,k>>, ok): the digests left in subtracted cells, with 1 for
    those of the first version and -1 for the second's; whether nothing was left."""
    kind = "array<struct<n:int,k:bigint>>"

    def round_of(s: Column) -> Column:
        alone = F.transform(
            F.filter(s["cells"], lambda c: F.abs(c["n"]) == 1),
            lambda c: let(_item(c["k"], seed, places), lambda i: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["x"].alias("x"), i["bits"].alias("bits"), (i["x"] == c["x"]).alias("ok"))),
        )

        def without(pure: Column) -> Column:
            left = F.zip_with(
                s["cells"],
                _all_bits(places),
                lambda c, b: F.aggregate(F.filter(pure, lambda p: p["bits"].bitwiseAND(b) != 0), c, lambda a, p: _cell(a["n"] - p["n"], a["k"].bitwiseXOR(p["k"]), a["x"].bitwiseXOR(p["x"]))),
            )
            found = F.concat(s["found"], F.transform(pure, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k"))))
            return F.struct(F.when(F.size(pure) > 0, left).otherwise(s["cells"]).alias("cells"), found.cast(kind).alias("found"), (F.size(pure) > 0).alias("go"))

        return let(F.array_distinct(F.filter(alone, lambda p: p["ok"])), without)

    start = F.struct(cells.cast(f"array<{_CELL}>").alias("cells"), F.array().cast(kind).alias("found"), F.lit(True).alias("go"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        start,
        lambda s, _: F.when(s["go"], round_of(s)).otherwise(s),
        lambda s: F.struct(s["found"].alias("found"), (~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["x"] != 0))).alias("ok")),
    )


def differing(one: Column, other: Column, first: Column) -> Column:
    """int: how many digests only one of two sets has, from what peeling their subtracted
    fingerprints gave ``first`` and, where that failed, larger sketches of the sets."""
    kind = "array<struct<a:array<bigint>,b:array<bigint>>>"
    size = lambda g: F.size(g["a"]) + F.size(g["b"])

    def dealt(g: Column, seed: Column) -> Column:
        """A failed group over as many groups as its size asks for, 2 at least and FAN at most."""
        parts = F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(size(g) / LOAD).cast("int")))
        placed = lambda side, n: F.transform(g[side], lambda d: F.struct(d.alias("d"), F.pmod(F.xxhash64(seed + 1000, d), n).alias("j")))

        def over(x: Column) -> Column:
            own = lambda side, j: F.transform(F.filter(x[side], lambda y: y["j"] == j), lambda y: y["d"])
            return F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda j: F.struct(own("a", j).alias("a"), own("b", j).alias("b")))

        return let(let(parts, lambda n: F.struct(n.alias("n"), placed("a", n).alias("a"), placed("b", n).alias("b"))), over)

    def attempt(s: Column, seed: Column) -> Column:
        def result(g: Column) -> Column:
            cells = subtract(sketch(g["a"], seed, RETRY_PLACES), sketch(g["b"], seed, RETRY_PLACES))
            peeled = let(peel(cells, seed, RETRY_PLACES, RETRY_ROUNDS), lambda p: F.when(p["ok"], F.size(p["found"])).otherwise(-1))
            d = F.when(size(g) == 0, 0).when(size(g) <= MOST_LOAD, peeled).otherwise(-1)
            return F.struct(g.alias("g"), d.alias("d"))

        tried = F.transform(F.flatten(F.transform(s["failed"], lambda g: dealt(g, seed))), result)

        def counted(t: Column) -> Column:
            done = F.aggregate(t, s["d"], lambda a, x: a + F.greatest(x["d"], F.lit(0)))
            return F.struct(done.cast("int").alias("d"), F.transform(F.filter(t, lambda x: x["d"] < 0), lambda x: x["g"]).cast(kind).alias("failed"))

        return let(tried, counted)

    start = F.struct(F.lit(0).cast("int").alias("d"), F.array(F.struct(one.alias("a"), other.alias("b"))).cast(kind).alias("failed"))
    exact = lambda g: F.size(F.array_except(g["a"], g["b"])) + F.size(F.array_except(g["b"], g["a"]))
    total = lambda s: F.aggregate(s["failed"], s["d"], lambda d, g: d + exact(g))
    larger = F.aggregate(F.sequence(F.lit(2), F.lit(RETRIES + 1)), start, lambda s, seed: F.when(F.size(s["failed"]) > 0, attempt(s, seed)).otherwise(s), total)
    return F.when(first["ok"], F.size(first["found"])).otherwise(larger)


def likeness(one: Column, other: Column, d: Column) -> Column:
    """Common paragraphs among all, from the sets' sizes and the recovered differences."""
    common = (F.size(one) + F.size(other) - d) / 2
    return F.when(common + d == 0, F.lit(1.0)).otherwise(common / (common + d))


def shown(paragraphs: Column, cells: Column) -> Column:
    """The fingerprint as text: number of paragraphs, then each cell in hexadecimal."""
    return F.concat_ws(":", F.size(paragraphs).cast("string"), F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["x"]))), ","))


def fingerprint(text: Column) -> Column:
    """The fingerprint of one text, without any neighbour."""
    return let(digests(text), lambda d: shown(d, sketch(d, F.lit(1))))


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_chars, edited, next_digests): every document with its text as edited by the next.

    Slim keys are put in order first.  A document then sends its successor's part, at most a
    quarter of what precedes it, and its paragraphs' digests to the document before it: whole
    texts are exchanged once, and no range of them is ever gathered.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, mark = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null")), F.xxhash64(text)
    slim = docs.select(F.col(id_col).alias("id"), key.alias("key"), mark.alias("mark"), F.length(text).alias("n")).groupBy("id", "key", "mark").agg(F.max("n").alias("n"))
    placed = numbered(slim, [F.col("id").asc_nulls_last(), F.col("mark")], "place").checkpoint()
    total = placed.count()
    before = placed.select(((F.col("place") + 1) % F.lit(max(1, total))).alias("place"), F.col("key").alias("to_key"), F.col("mark").alias("to_mark"), F.col("n").alias("to_n"))
    linked = placed.join(before, "place").select("id", "key", "mark", "to_key", "to_mark", "to_n").checkpoint()
    bodies = docs.select(key.alias("own_key"), mark.alias("own_mark"), text.alias("body"))
    own = bodies.join(linked, (F.col("own_key") == F.col("key")) & (F.col("own_mark") == F.col("mark")))
    sent = own.select("to_key", "to_mark", F.expr("substring(body, 1, to_n div 4)").alias("prefix"), digests(F.col("body")).alias("next_digests"))
    # rows alike in id and text send alike
    sent = sent.groupBy("to_key", "to_mark").agg(F.first("prefix").alias("prefix"), F.first("next_digests").alias("next_digests"))
    both = own.select("id", "own_key", "own_mark", "body").join(sent, (F.col("own_key") == F.col("to_key")) & (F.col("own_mark") == F.col("to_mark")))
    n = F.length("body")
    return both.select(F.col("id").alias(id_col), F.col("body").alias("text"), n.cast("long").alias("n_chars"), F.concat(F.expr("substring(body, 1, length(body) - length(body) div 4)"), F.col("prefix")).alias("edited"), "next_digests")


def version_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = with_successor(docs, id_col, text_col)
    # a column for each step: what is used more than once is computed once
    sets = rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("__own"), digests(F.col("edited")).alias("__edited"), F.col("next_digests").alias("__next"))
    cells = sets.select("*", *(sketch(F.col(f"__{k}"), F.lit(1)).alias(f"__{k}_cells") for k in ("own", "edited", "next")))
    first = cells.select("*", *(peel(subtract(F.col("__own_cells"), F.col(f"__{k}_cells")), F.lit(1)).alias(f"__{k}_found") for k in ("edited", "next")))
    counted = first.select("*", *(differing(F.col("__own"), F.col(f"__{k}"), F.col(f"__{k}_found")).alias(f"__{k}_d") for k in ("edited", "next")))
    prints = (shown(F.col(f"__{k}"), F.col(f"__{k}_cells")).alias(name) for k, name in (("own", "fingerprint"), ("edited", "edited_fingerprint")))
    near = (likeness(F.col("__own"), F.col(f"__{k}"), F.col(f"__{k}_d")).alias(f"near_{k}") for k in ("edited", "next"))
    return counted.select(id_col, "n_chars", "edited_sha256", *prints, *near)
