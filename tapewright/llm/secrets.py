"""Secrets in texts: three fixed patterns, and windows of high entropy.

The entropy scan cuts candidate strings (runs of characters that keys are made of,
with a digit and a letter), moves a window over each, and keeps the counts of the
window's characters by adding the one that enters and taking away the one that
leaves; the sum of c*log2(c) follows with them. A candidate whose highest window
reaches the threshold of its character class is a secret, unless an allow-list
pattern matches it or one of the fixed patterns has already found it.

Everything is DataFrame functions; places are code points, counted from the pieces
between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
MOST_WINDOW = 70  # a count is one ASCII character
#: class of a candidate (the first whose pattern it matches): bits that the best window must reach
CLASSES = (("hex", "^[0-9a-fA-F]+$", 2.95), ("mixed", "[A-Z].*[a-z]|[a-z].*[A-Z]", 3.75), ("plain", "", 3.65))
ALLOWED = ("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "[eE][xX][aA][mM][pP][lL][eE]", "01234567|12345678|abcdefgh|ABCDEFGH", "^[0-9+/_=-]*$")

_SPAN = "array<struct<start:int,`end`:int,found:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, start: Column, step, wanted, told, kind: str) -> Column:
    """Left to right over an array: ``told(state, item)`` of the items for which ``wanted(state, item)``, where ``step(state, item)`` is the next state.

    An array that grows by one item is copied for it. So items go in runs of about the root of their number:
    answers grow within a run, and the runs' answers are put together at the end.
    """
    none = F.array().cast(kind)

    def within(done: Column, item: Column) -> Column:
        one = F.array(told(done["state"], item)).cast(kind)
        return F.struct(step(done["state"], item).alias("state"), F.when(wanted(done["state"], item), F.concat(done["out"], one)).otherwise(done["out"]).alias("out"))

    def across(done: Column, run: Column) -> Column:
        return F.concat(done, F.array(F.aggregate(run, F.struct(F.element_at(done, -1)["state"].alias("state"), none.alias("out")), within)))

    def runs(held: Column, side: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / side).cast("int")), lambda k: F.slice(held, k * side + 1, side))

    def found(held: Column) -> Column:
        dealt = _let(F.ceil(F.sqrt(F.size(held))).cast("int"), lambda side: runs(held, side))
        out = F.aggregate(dealt, F.array(F.struct(start.alias("state"), none.alias("out"))), across, lambda done: F.flatten(F.transform(done, lambda d: d["out"])))
        return F.when(F.size(held) > 0, out).otherwise(none)

    return _let(items, found)


def _spans(text: Column, pattern: str, keep) -> Column:
    """(start, end, found) of the non-overlapping matches, leftmost first, that ``keep`` lets through."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.transform(pieces, F.length).alias("before"), found.alias("found")), lambda e: e["found"].isNotNull())
    spans = _scan(
        pairs, F.lit(0), lambda at, e: at + e["before"] + F.length(e["found"]), lambda _, e: keep(e["found"]),
        lambda at, e: F.struct((at + e["before"]).alias("start"), (at + e["before"] + F.length(e["found"])).alias("end"), e["found"].alias("found")), _SPAN,
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _apart(spans: Column, taken: Column) -> Column:
    """The ``spans`` that overlap none of ``taken``: all are sorted, one scan tells how far those before reach, one backwards where the next begins."""
    kind = "array<struct<start:int,`end`:int,found:string,free:boolean,reach:int>>"
    mark = lambda c, free: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(free).alias("free"), s["end"].alias("end"), s["found"].alias("found")))
    marked = F.concat(mark(taken, False), mark(spans, True))
    always = lambda *_: F.lit(True)
    ahead = _scan(
        F.array_sort(marked), F.lit(0), lambda reach, s: F.when(s["free"], reach).otherwise(F.greatest(reach, s["end"])), always,
        lambda reach, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), s["free"].alias("free"), reach.alias("reach")), kind,
    )
    back = _scan(
        F.reverse(ahead), F.lit(2**31 - 1), lambda begins, s: F.when(s["free"], begins).otherwise(s["start"]),
        lambda begins, s: s["free"] & (s["reach"] <= s["start"]) & (begins >= s["end"]), lambda _, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")), _SPAN,
    )
    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), F.reverse(back)).otherwise(spans)


def _best_entropy(candidate: Column, window: int) -> Column:
    """The highest entropy of any window, in one pass: a step costs the same wherever it is.

    The counts of the window are a string with one character a letter of ALPHABET; the
    letter that enters and the one that leaves are overwritten in place.
    """
    letters = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    moves = F.arrays_zip(letters.alias("enters"), F.concat(F.array_repeat(F.lit(0), window), letters).alias("leaves"), F.sequence(F.lit(1), F.length(candidate)).alias("nth"))

    def f(c: Column) -> Column:
        return F.when(c <= 1, F.lit(0.0)).otherwise(c * F.log2(c.cast("double")))

    def count(counts: Column, letter: Column) -> Column:
        return F.ascii(F.substring(counts, letter, F.lit(1))) - 48

    def put(counts: Column, letter: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + 48), letter, F.lit(1))

    def step(state: Column, e: Column) -> Column:
        more, less = count(state["counts"], e["enters"]), count(state["counts"], e["leaves"])
        turns = (e["leaves"] > 0) & (e["enters"] != e["leaves"])
        grown = F.when(e["enters"] == e["leaves"], state["counts"]).otherwise(put(state["counts"], e["enters"], more + 1))
        counts = F.when(turns, put(grown, e["leaves"], less - 1)).otherwise(grown)
        rise = F.when(e["enters"] == e["leaves"], F.lit(0.0)).otherwise(f(more + 1) - f(more))
        total = state["total"] + rise + F.when(turns, f(less - 1) - f(less)).otherwise(F.lit(0.0))
        best = F.when(e["nth"] >= window, F.greatest(state["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

    start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    inside = F.filter(moves, lambda e: e["enters"].isNotNull())  # the last ``window`` letters leave no more
    return F.aggregate(inside, start, step, lambda s: s["best"])


def _secret(candidate: Column, window: int, allowed: tuple[str, ...]) -> Column:
    bits = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        bits = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(bits) if pattern else F.lit(least)
    listed = F.lit(False)
    for pattern in allowed:
        listed = listed | candidate.rlike(pattern)
    worth = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]") & ~listed
    return F.when(worth, _best_entropy(candidate, window) >= bits).otherwise(F.lit(False))


def scan(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of ``docs``: doc_id, the arrays assign, access, hex and entropy, each of (start, end, found).

    Places are code points of the whole text, ends exclusive. A null text is empty
    and has no spans. Entropy spans that overlap one of the others are left out. Repeated
    rows get equal answers; other columns are ignored; an empty table gives no rows. The time
    for a candidate grows with its length alone, and that for a text about with the number of its spans.
    window: characters, 70 at most.
    """
    if not 1 < window <= MOST_WINDOW:
        raise ValueError(f"a window has 2 to {MOST_WINDOW} characters")
    text = F.coalesce(F.col("text"), F.lit(""))
    always = lambda _: F.lit(True)
    base = docs.select("doc_id", text.alias("_text")).select(
        "doc_id", "_text",
        _spans(F.col("_text"), ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8).alias("assign"),
        _spans(F.col("_text"), ACCESS, always).alias("access"),
        _spans(F.col("_text"), HEX, always).alias("hex"),
        _spans(F.col("_text"), CANDIDATE, always).alias("_dense"),
    )
    # only candidates that no fixed pattern has found are worth a look at their windows
    free = base.select("doc_id", "assign", "access", "hex", _apart(F.col("_dense"), F.concat("assign", "access", "hex")).alias("_free"))
    return free.select("doc_id", "assign", "access", "hex", F.filter("_free", lambda s: _secret(s["found"], window, allowed)).alias("entropy"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start, then kind)."""
    kinds = ("assign", "access", "hex", "entropy")

    def tag(nth: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def listed(names: tuple[str, ...]) -> Column:
        tagged = [tag(n, k) for n, k in enumerate(kinds) if k in names]
        return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return scanned.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(listed(kinds[:3]), 256).alias("base_sha256"),
        listed(kinds).alias("spans"),
    )
