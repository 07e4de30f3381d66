"""Secret scans with DataFrame functions only.

Base findings come from three patterns (assignments, access keys, hex runs). Entropy findings are added to them: in every
candidate string (a run of key characters with a letter and a digit), a window of ``WINDOW`` characters slides over
the run, and its Shannon entropy is kept by incremental counts: a step takes one character out and puts one in, so
the sum of ``c log2 c`` changes by two known terms. A candidate is a finding if some window reaches the bar of the string's
character class: hex digits, one letter case with digits, or both cases with digits. Candidates are looked for in what the
assignments leave of the text; those on the allow list and those that hold an access key or a hex run are suppressed.

Everything is linear in the text. Matches are found by splitting at them, and their places are sums over blocks of
``BLOCK`` matches. The counts of a window are five bits a character in seven numbers, so that a step is the same small work
whatever the run's length, and a run is taken in overlapping pieces of ``PIECE`` characters. No pattern repeats a group,
so none makes the regular-expression engine recurse.

Spans are code points, end exclusive. Defined cases: null text counts as empty; no finding gives zero counts, an empty
``spans`` and the digest of the empty string; very long texts and runs are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, text_or_empty

#: Fixed by the contract; the length that counts is that of the second group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The contract's ``AKIA[A-Z0-9]+`` of 18 characters or more and ``[0-9a-f]+`` of 16 or more. Both patterns take whole runs, so
#: asking for the length in the pattern finds the same matches without a row for every short run of prose.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}+", r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Entropy in bits a character from which a window of each class is a finding; log2(20) = 4.32 is the most.
BARS = {"hex": 2.8, "single": 3.4, "mixed": 3.5}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Allow list: UUIDs, plain numbers and dates, one character repeated, documented example keys, words joined by marks.
ALLOW = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9+/_=-]+$|EXAMPLE|example|sample|dummy|placeholder|xxxx|XXXX"
#: A part of a name between marks: a word with a short number, a number, or nothing.
NAME = r"^[A-Za-z]*[0-9]{0,2}$|^[0-9]+$"
#: Matches whose places are summed up together, and characters of a run that are scanned together.
BLOCK, PIECE = 256, 4096

_SPAN = "array<struct<s: int, e: int, k: int, w: string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column) -> Column:
    """The sum up to each place of an array of int; arrays of more than a block grow by blocks, not by single values."""

    def sums(block: Column, base: Column) -> Column:
        state = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: _let(acc["at"] + x, lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))
        return F.aggregate(block, state, step, lambda acc: acc["out"])

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda a, b: a + b)

    def over(blocks: Column) -> Column:
        upto = sums(F.transform(blocks, total), F.lit(0))
        return F.flatten(F.zip_with(blocks, upto, lambda block, to: sums(block, to - total(block))))

    return _let(numbers, lambda v: _let(F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.slice(v, k + 1, F.lit(BLOCK))), over))


def _found(text: Column, pattern: str, may: str, group: int = 0, least: int = 1) -> Column:
    """array<struct(start, end, length of the group, match)> of leftmost non-overlapping matches whose group reaches ``least``."""
    # Between the matches lie the parts of a split; the last part has no match after it.
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("key"))

    def placed(rows: Column) -> Column:
        ends = running_sums(F.transform(rows, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["w"]), F.lit(0))))
        named = F.zip_with(rows, ends, lambda x, e: F.struct((e - F.length(x["w"])).alias("s"), e.alias("e"), F.length(x["key"]).alias("k"), x["w"].alias("w")))
        return F.filter(named, lambda x: x["k"] >= least)

    return F.when(text.rlike(may), _let(parts, placed)).otherwise(F.array().cast(_SPAN))


def _without_assignments(text: Column, may: str) -> Column:
    """The text with each assignment that counts blanked out, so that places stay."""
    parts = F.arrays_zip(F.split(text, ASSIGN).alias("gap"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("w"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("key"))
    blank = lambda x: F.when(F.length(x["key"]) >= 12, F.repeat(F.lit(" "), F.length(x["w"]))).otherwise(F.coalesce(x["w"], F.lit("")))
    return F.when(text.rlike(may), F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], blank(x))), "")).otherwise(text)


def top_entropy(word: Column, window: int = WINDOW) -> Column:
    """The largest entropy of any window of a run of key characters; zero for a run under the window.

    The counts of the 80 characters from '+' to 'z' are five bits each, twelve in a number.
    """
    # gain[c]: how much c log2 c grows when a count of c goes up by one.
    gain = F.array(*[F.lit((c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0)) for c in range(window)])
    pieces = F.regexp_extract_all(word, F.lit(rf"(?=([^\n]{{{window},{PIECE + window - 1}}}))[^\n]{{1,{PIECE}}}"), F.lit(1))

    def place(c: Column) -> Column:
        return _let(F.ascii(c) - 43, lambda code: F.struct((F.floor(code / 12)).cast("int").alias("at"), (code % 12 * 5).alias("by")))

    def step(acc: Column, pair: Column) -> Column:
        into, out, counts = pair["into"], pair["out"], acc["counts"]
        count = lambda x: F.call_function("shiftright", F.element_at(counts, x["at"] + 1), x["by"]).bitwiseAND(31).cast("int")
        one = lambda x, k: F.when(x["at"] == k, F.call_function("shiftleft", F.lit(1).cast("long"), x["by"])).otherwise(F.lit(0).cast("long"))
        more = F.element_at(gain, count(into) + 1)
        change = F.when(out.isNull(), more).when((into["at"] == out["at"]) & (into["by"] == out["by"]), 0.0).otherwise(more - F.element_at(gain, count(out)))
        new = F.transform(counts, lambda w, k: w + one(into, k) - F.when(out.isNull(), F.lit(0).cast("long")).otherwise(one(out, k)))
        return _let(acc["total"] + change, lambda total: F.struct(new.alias("counts"), total.alias("total"), F.when(acc["n"] < window - 1, acc["least"]).otherwise(F.least(total, acc["least"])).alias("least"), (acc["n"] + 1).alias("n")))

    def piece_top(piece: Column) -> Column:
        def over(places: Column) -> Column:
            before = F.concat(F.array_repeat(F.lit(None).cast("struct<at: int, by: int>"), window), F.slice(places, 1, F.size(places) - window))
            start = F.struct(F.array_repeat(F.lit(0).cast("long"), 7).alias("counts"), F.lit(0.0).alias("total"), F.lit(window * log2(window)).alias("least"), F.lit(0).alias("n"))
            return F.aggregate(F.arrays_zip(places.alias("into"), before.alias("out")), start, step, lambda acc: log2(window) - acc["least"] / window)

        return _let(F.transform(F.split(piece, ""), place), over)

    return F.coalesce(F.array_max(F.transform(pieces, piece_top)), F.lit(0.0))


def _bar(word: Column) -> Column:
    return F.when(word.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), BARS["hex"]).when(word.rlike("[a-z]") & word.rlike("[A-Z]"), BARS["mixed"]).otherwise(BARS["single"])


def _allowed(word: Column) -> Column:
    same = F.replace(word, F.substring(word, 1, 1), F.lit("")) == ""
    return word.rlike(ALLOW) | same | F.forall(F.split(word, "[/_=-]"), lambda x: x.rlike(NAME))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    rows = pick(df, doc=id_col, text=text_col).select("doc", text_or_empty(F.col("text")).alias("text"))
    t, may = F.col("text"), r"(?i)passw|secret|token|api_?key"
    found = rows.select(
        "doc",
        _found(t, ASSIGN, may, 2, 12).alias("assign"),
        _found(t, ACCESS, r"AKIA[A-Z0-9]{14}", 0, 18).alias("access"),
        _found(t, HEX, r"[0-9a-f]{16}", 0, 16).alias("hex"),
        F.when(t.rlike(CANDIDATE), _let(_without_assignments(t, may), lambda left: _found(left, CANDIDATE, CANDIDATE, 0, 20))).otherwise(F.array().cast(_SPAN)).alias("runs"),
    )
    worth = lambda x: x["w"].rlike("[0-9]") & x["w"].rlike("[A-Za-z]") & ~x["w"].rlike(f"{ACCESS}|{HEX}") & ~_allowed(x["w"]) & (top_entropy(x["w"]) >= _bar(x["w"]))
    found = found.withColumn("entropy", F.filter("runs", worth))

    def listed(*kinds: str) -> Column:
        def name(kind: str) -> Column:
            i, mark = F.lit(KINDS.index(kind)), F.lit(f"{kind}:")
            return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), i.alias("i"), F.concat(mark, x["s"].cast("string"), F.lit(":"), x["e"].cast("string")).alias("t")))

        named = [name(kind) for kind in kinds]
        return F.array_join(F.transform(F.array_sort(F.concat(*named)), lambda x: x["t"]), ",")

    sizes = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(F.col("doc").alias(id_col), *sizes[:3], F.sha2(listed(*KINDS[:3]), 256).alias("base_sha256"), listed(*KINDS).alias("spans"), sizes[3])
