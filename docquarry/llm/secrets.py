"""Secret scans with multipart credential linking, by column expressions alone.

Base findings are assignments of secret-looking names, access key ids and long hexadecimal
runs.  Beside them stand weak candidates that prove nothing alone: account or client
identifiers, random-looking strings and endpoints.  A scope is a paragraph, ended by a blank line
and else of any length.  Every part is an interval of lines, found once in the whole text; parts of one
scope are joined by interval, that is where REACH lines or fewer, both counted, hold them both,
wherever in the text that is.  A weak candidate is reported only where its complement is joined:

* ``weak_secret`` beside an identifier (weak or an access key) or an endpoint,
* ``weak_id`` beside a secret (weak or base),
* ``endpoint`` beside both.

The join merges the parts in the order of their lines, once forwards and once backwards, so no pairs are
made and nothing is exchanged; the work follows the text, and n * sqrt(n) for its n parts.  Offsets count code points, ends are exclusive.  Null and empty texts have no
spans; repeated rows are scanned alike; runs of line ends, long lines and many lines have no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import let, running

BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
#: Lines, both ends counted, within which parts of a scope belong together.
REACH = 12

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_ID = r"""(?<![A-Za-z0-9])(?i:(?:client|app|application|user|account|tenant|project|access_?key|key)[_-]?(?:id|name)|login|username)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9._@-]{2,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[a-zA-Z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"""(?i:https?|wss?|jdbc:[a-z]+|amqps?|redis|mongodb|postgres(?:ql)?|mysql|s3)://[^\x20\x09-\x0D"'<>]+|(?i:endpoint|host|hostname|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:/_-]{2,}"""
_BLANK_LINE = r"\n[\x20\t\r]*+(?=\n)"
PATTERNS = (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT)
#: Characters of a group that a match needs.
LEAST = {0: 6}
#: Places in PATTERNS of identifiers, secrets and endpoints.
ROLES = {"i": (1, 3), "s": (0, 2, 4), "e": (5,)}
_PART = "array<struct<at:int,start:int,order:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_PART)


def _matched(text: Column, order: int, placed: bool) -> Column:
    """The leftmost non-overlapping matches of a pattern as parts.  Matches and the pieces between
    them come in turn, so that their lengths, summed up, give the places; where ``placed``, also
    their lines: the line ends before, and REACH more for each blank line, so that parts with
    a blank line between are never within reach."""
    pattern = PATTERNS[order]

    def parts(matches: Column) -> Column:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if order in LEAST else matches

        def lines(piece: Column) -> Column:
            if not placed:
                return F.lit(0)
            ends = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
            return F.when(ends > 1, ends + REACH * F.regexp_count(piece, F.lit(_BLANK_LINE))).otherwise(ends)

        # the piece after the last match has no match; lines and characters are summed up in one number
        one = F.lit(1 << 32)
        pieces = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda p: lines(p) * one + F.length(p))
        sizes = F.zip_with(matches, groups, lambda m, g: F.struct(F.length(m).alias("long"), (F.length(g) >= LEAST.get(order, 0)).alias("kept")))
        upto = running(F.zip_with(pieces, matches, lambda p, m: p + F.length(m)), lambda a, b: a + b)

        def part(x: Column, m: Column) -> Column:
            end = x.bitwiseAND(F.lit((1 << 32) - 1))
            return F.struct(F.shiftright(x, 32).cast("int").alias("at"), (end - m["long"]).cast("int").alias("start"), F.when(m["kept"], order).alias("order"), end.cast("int").alias("end"))

        return F.filter(F.zip_with(upto, sizes, part), lambda x: x["order"].isNotNull()).cast(_PART)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, parts(m)).otherwise(_none()))


def _assigns(text: Column) -> Column:
    """Whether a text holds any sign of assignment: a plain search that spares most
    texts the regular expressions that need one."""
    return text.contains(":") | text.contains("=")


def base_parts(text: Column, placed: bool = False) -> Column:
    return F.concat(
        F.when(_assigns(text), _matched(text, 0, placed)).otherwise(_none()),
        F.when(text.contains("AKIA"), _matched(text, 1, placed)).otherwise(_none()),
        _matched(text, 2, placed),
    )


def _joined(parts: Column, sign: int) -> Column:
    """For each part, whether an identifier, a secret and an endpoint are within reach on one
    side: before it in the order of lines, or with sign -1 in the reversed one."""
    nearest = F.greatest if sign > 0 else F.least

    def last(orders: tuple[int, ...]) -> Column:
        return running(F.transform(parts, lambda p: F.when(p["order"].isin(*orders), p["at"]).otherwise(-sign * (1 << 30))), nearest)

    def near(p: Column, x: Column) -> Column:
        return F.struct(*((sign * (p["at"] - x[k]) < REACH).alias(k) for k in ROLES))

    return F.zip_with(parts, F.arrays_zip(*(last(orders).alias(k) for k, orders in ROLES.items())), near)


def linked(parts: Column) -> Column:
    """The weak candidates among the parts whose complements are within reach."""

    def both(x: Column) -> Column:
        near = F.zip_with(x["before"], F.reverse(x["after"]), lambda p, q: F.struct(*((p[k] | q[k]).alias(k) for k in ROLES)))

        def kept(p: Column, n: Column) -> Column:
            ok = F.when(p["order"] == 3, n["s"]).when(p["order"] == 4, n["i"] | n["e"]).when(p["order"] == 5, n["i"] & n["s"]).otherwise(False)
            return F.struct(ok.alias("ok"), p.alias("part"))

        return F.transform(F.filter(F.zip_with(x["parts"], near, kept), lambda y: y["ok"]), lambda y: y["part"])

    def sides(p: Column) -> Column:
        return let(F.struct(p.alias("parts"), _joined(p, 1).alias("before"), _joined(F.reverse(p), -1).alias("after")), both)

    return let(F.sort_array(parts), sides).cast(_PART)


def found_parts(text: Column) -> Column:
    """struct(base, linked): the base parts, and the weak ones whose complements are there."""
    # every link needs an identifier or an endpoint, and these a sign of assignment or an access key
    possible = text.contains("AKIA") | (_assigns(text) & (text.rlike(WEAK_ID) | text.rlike(ENDPOINT)))

    def all_parts(base: Column) -> Column:
        weak = F.concat(*(_matched(text, k, True) for k in (3, 4, 5)))
        return F.struct(base.alias("base"), linked(F.concat(base, weak)).alias("linked"))

    bare = F.struct(base_parts(text).alias("base"), _none().alias("linked"))
    return F.when(possible, let(base_parts(text, placed=True), all_parts)).otherwise(bare)


def _shown(parts: Column) -> Column:
    """Parts by start, then kind, as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*BASE, *WEAK)))
    placed = F.sort_array(F.transform(parts, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"))))
    return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): one row per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def shown(p: Column) -> Column:
        counts = (F.size(F.filter(p["base"], lambda s: s["order"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE))  # noqa: B023
        return F.struct(*counts, F.sha2(_shown(p["base"]), 256).alias("base_sha256"), _shown(F.concat(p["base"], p["linked"])).alias("spans"))

    found = let(text, lambda t: let(found_parts(t), shown))
    return docs.select(F.col(id_col), found.alias("__found")).select(id_col, "__found.*")
