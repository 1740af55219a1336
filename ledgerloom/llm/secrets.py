"""Secret scan with DataFrame functions only.

Base kinds (leftmost non-overlapping matches of one pattern each; a match that
fails its length is dropped, and what it covered isn't looked at again):

* ``assign``: a key name, an assignment sign and a value of 12 characters or more
* ``access``: an access key id of 18 characters or more
* ``hex``: a run of 16 lower-case hexadecimal digits or more

The method adds kind ``entropy``: candidate strings are runs of 20 or more
characters of the base-64 alphabet.  A window of
``WINDOW`` characters slides over each; the counts of its characters are kept
incrementally (one comes in, one goes out), and with them the sum of
count * log2(count), from which the Shannon entropy follows.  So are the places of the last letter, the last
digit and the last character that is no hexadecimal digit of either case: they tell each
window's own character class, the first of these that fits,

* ``digits``: digits and signs
* ``hex``: hexadecimal digits of one case
* ``letters``: letters and signs, as in words and paths
* ``base64``: anything else

and each class has a limit of its own.  The candidate is reported if a window reaches the limit of its class, unless the
allow list suppresses it (UUIDs, integrity digests) or a base span covers it.  The work is in
proportion to the candidate's length.

Positions are code points, ends exclusive.  Null and empty texts have no
spans; texts and candidates of any length are scanned whole; rows are independent, so ties and repeated rows need no rule; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# A run shorter than 16 digits would be dropped, and a run's inside holds no longer run: the bound can stand in the pattern.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
_CHUNK = 256
#: Bits per character that a window has to reach, by class, about what 19 in 20 windows of 20 random characters of the class have.
#: Lower-case random letters have 3.8 on average, words and paths below 3.7 nearly always, random letters of both cases 4.05.
LIMITS = {"digits": 2.62, "hex": 3.0, "letters": 3.75, "base64": 3.72}
#: Forms that are public by nature.
ALLOW = r"^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?:sha(?:1|256|384|512)|md5)-.*)$"
#: Codes of candidates' characters start here: "+" is 1.
_FIRST = 42
#: A window's 80 counts are kept in the bits of a few long integers.
_BITS, _IN_WORD, _WORDS = 5, 12, 7


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    """The items some at a time; ``items`` is a bound value or a column, as it is looked at for each chunk."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / _CHUNK).cast("int")), lambda k: F.slice(items, k * _CHUNK + 1, F.lit(_CHUNK)))


def _running(items: Column, step, kind: str) -> Column:
    """A left-to-right pass over an array that carries a place ``at`` from 0: ``step(at, x)`` gives the next place and an
    array of results.  The last place and all results, as (at, got).

    Each addition copies the results so far, so items are passed over some at a time.
    """

    def one(state: Column, x: Column) -> Column:
        at, new = step(state["at"], x)
        return F.struct(at.alias("at"), F.concat(state["got"], new).alias("got"))

    def chunk(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("got")), one)
        return F.element_at(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(state["got"], x["got"]).alias("got"))), 1)

    seed = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("got"))
    return _bound(items, lambda bound: F.aggregate(_chunks(bound), seed, chunk, lambda state: F.struct(state["at"].alias("at"), F.flatten(state["got"]).alias("got"))))


def _at(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as (s, e, m), code points: the pieces between matches give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    kind = "struct<s:int,e:int,m:string>"

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.char_length(pair["gap"])
        end = start + F.char_length(pair["m"])
        return end, F.array(F.struct(start.alias("s"), end.alias("e"), pair["m"].alias("m")))

    paired = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    return F.when(text.rlike(pattern), _running(paired, step, kind)["got"]).otherwise(F.array().cast(f"array<{kind}>"))


def _spans(found: Column, kind: str, keep) -> Column:
    return F.transform(F.filter(found, keep), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def _over_windows(token: Column, judged, window: int) -> Column:
    """The largest ``judged(entropy, state)`` of any ``window`` consecutive characters of a base-64 token, null if there are fewer.

    ``state`` has the places of the last letter, digit, and characters outside of either hexadecimal alphabet, and the window's own (at).
    """

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def change(state: Column, c: Column, by: int) -> Column:
        """Counts and sum with one character more or less."""
        word, place = F.call_function("div", c, F.lit(_IN_WORD)).cast("int"), (c % _IN_WORD) * _BITS

        def counted(n: Column) -> Column:
            one = F.call_function("shiftleft", F.lit(by).cast("long"), place)
            counts = F.concat(F.slice(state["counts"], F.lit(1), word), F.array(F.element_at(state["counts"], word + 1) + one), F.slice(state["counts"], word + 2, F.lit(_WORDS)))
            return F.struct(counts.alias("counts"), (state["sum"] + term(n + F.lit(by)) - term(n)).alias("sum"))

        n = F.call_function("shiftright", F.element_at(state["counts"], word + 1), place).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))
        return _bound(n, counted)

    def inside(c: Column, first: str, last: str) -> Column:
        return c.between(ord(first) - _FIRST, ord(last) - _FIRST)

    def last(held: Column, is_it: Column, at: Column) -> Column:
        return F.when(is_it, at).otherwise(held)

    def step(state: Column, pair: Column) -> Column:
        c, at = pair["now"], pair["at"]
        left = _bound(change(state, c, 1), lambda entered: F.when(at < window, entered).otherwise(change(entered, pair["old"], -1)))
        digit, lower, upper = inside(c, "0", "9"), inside(c, "a", "z"), inside(c, "A", "Z")
        seen = F.struct(
            left.alias("counts"),
            last(state["letter"], lower | upper, at).alias("letter"),
            last(state["digit"], digit, at).alias("digit"),
            last(state["not_lower"], ~(digit | inside(c, "a", "f")), at).alias("not_lower"),
            last(state["not_upper"], ~(digit | inside(c, "A", "F")), at).alias("not_upper"),
            at.alias("at"),
        )

        def after(x: Column) -> Column:
            entropy = F.log2(F.lit(float(window))) - x["counts"]["sum"] / F.lit(float(window))
            best = F.when(at >= window - 1, F.greatest(state["best"], judged(entropy, x))).otherwise(state["best"])
            return F.struct(x["counts"]["counts"].alias("counts"), x["counts"]["sum"].alias("sum"), best.alias("best"), *(x[k].alias(k) for k in ("letter", "digit", "not_lower", "not_upper")))

        return _bound(seen, after)

    def over(code: Column) -> Column:
        pairs = F.transform(code, lambda c, i: F.struct(c.alias("now"), F.when(i >= window, F.element_at(code, i - window + 1)).otherwise(F.lit(1)).alias("old"), i.alias("at")))
        never = F.lit(-1)
        seed = F.struct(F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best"), *(never.alias(k) for k in ("letter", "digit", "not_lower", "not_upper")))
        return F.aggregate(pairs, seed, step, lambda state: state["best"])

    return _bound(F.transform(F.slice(F.split(token, ""), F.lit(1), F.char_length(token)), lambda x: F.ascii(x) - _FIRST), over)


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits per character) of any ``window`` consecutive characters of a base-64 token; 0 if there are fewer."""
    return F.coalesce(_over_windows(token, lambda entropy, state: entropy, window), F.lit(0.0))


def _margin(entropy: Column, state: Column) -> Column:
    """How far a window is above the limit of its class."""
    before = state["at"] - WINDOW  # the last place before the window
    hexed = (state["not_lower"] <= before) | (state["not_upper"] <= before)
    limit = F.when(state["letter"] <= before, LIMITS["digits"]).when(hexed, LIMITS["hex"]).when(state["digit"] <= before, LIMITS["letters"]).otherwise(LIMITS["base64"])
    return entropy - limit


def _suspicious(x: Column) -> Column:
    return ~x["m"].rlike(ALLOW) & (_over_windows(x["m"], _margin, WINDOW) >= 0)


def _found(frame: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns and ``found`` of a frame that has ``text`` without nulls."""
    text = F.col("text")
    some = frame.withColumn("assign", _at(text, ASSIGN)).withColumn("access", _at(text, ACCESS)).withColumn("hex", _at(text, HEX)).withColumn("high", _at(text, CANDIDATE))
    assign = _spans(F.col("assign"), "assign", lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)
    access = _spans(F.col("access"), "access", lambda x: F.char_length(x["m"]) >= 18)
    hexed = _spans(F.col("hex"), "hex", lambda x: F.char_length(x["m"]) >= 16)
    based = some.select(*kept, F.concat(assign, access, hexed).alias("base"), "high")
    fresh = _spans(F.col("high"), "entropy", lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])) & _suspicious(x))
    return based.select(*kept, F.sort_array(F.concat("base", fresh)).alias("found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``found``: all spans (s, k, e) by start, then kind as in ``KINDS``."""
    return _found(text_of(docs, F.col(id_col).alias("doc_id"), text=text_col), ["doc_id"])


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans by kind, the digest of the base spans and all spans."""
    found = F.col("found")

    def number(kind: int) -> Column:
        return F.size(F.filter(found, lambda x: x["k"] == kind)).cast("long")

    base = F.sha2(joined(F.filter(found, lambda x: x["k"] < 3)), 256)
    return scan(docs).select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), base.alias("base_sha256"), joined(found).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    def stretch(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        before = F.array(stretch(at, x["s"]))
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, before).otherwise(F.slice(before, 1, 0))

    def cut(chunk: Column) -> Column:
        """The stretches of a chunk, taken from the part of the text that they lie in."""
        base = F.element_at(chunk, 1)["a"]
        part = F.struct(F.substring(text, base + 1, F.element_at(chunk, -1)["b"] - base).alias("t"), base.alias("base"), chunk.alias("c"))
        return F.element_at(F.transform(F.array(part), lambda p: F.transform(p["c"], lambda x: F.substring(p["t"], x["a"] - p["base"] + 1, x["b"] - x["a"]))), 1)

    passed = F.transform(F.array(_running(found, step, "struct<a:int,b:int>")), lambda x: F.array_append(x["got"], stretch(x["at"], F.char_length(text))))
    pieces = F.transform(passed, lambda kept: F.flatten(F.transform(_chunks(kept), cut)))
    return F.when(F.size(found) > 0, F.array_join(F.element_at(pieces, 1), mark)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, with secrets replaced in the text and ``count_col``, if there is one, that of the new text."""
    clean = _found(packed(docs, text=text_col), ["row", "text"]).withColumn("clean", redacted(F.col("text"), F.col("found")))
    changed = F.size("found") > 0
    columns = []
    for field in docs.schema:
        value = F.col("row")[field.name]
        if field.name == text_col:
            value = F.when(changed, F.col("clean")).otherwise(value)
        elif field.name == count_col:
            value = F.when(changed, F.char_length("clean").cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return clean.select(*columns)
