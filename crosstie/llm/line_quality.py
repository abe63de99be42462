"""Line-first cleaning: rules per line, then a verdict on the document.

Everything is an expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import let, line_words

#: a prose line ends with one of these, closing quotes or brackets aside
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*$"
#: parts that link lists, breadcrumbs and menus stand between
SEPARATOR = r"^[|>»•·/\\]+,?$"
SEPARATOR_CHAR = r"[|>»•·/\\]"
#: found in a line with an upper-case word; only such lines are counted word by word
SHOUT = r"!!|\p{Lu}[^\p{Ll} ]|[^\p{Ll} ]\p{Lu}"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "privacy policy", "terms of use", "terms of service", "cookie policy",
    "accept cookies", "accept all cookies", "enable javascript", "subscribe now", "click here", "read more", "share this", "powered by",
    "skip to content",
)
#: characters that mark mark-up residue
SYMBOLS = "#*$%&|<>"

#: shares of a line or a document at which a rule fails
MAX_SYMBOL_SHARE = 0.1
MAX_SEPARATOR_SHARE = 0.2
MAX_SHOUT_SHARE = 0.7
MAX_RUN_SHARE = 0.3
MIN_PROSE_WORDS = 3
MAX_LOST_SHARE = 0.5


def _judged(line: Column) -> Column:
    """A line with its words, counts and the name of the first rule that it
    fails (null: it passes all).

    ``symbols``: over a tenth of its visible characters are mark-up residue.
    ``navigation``: over a fifth of its words are separators, or it has fewer
    than three words and no sentence end.  ``shouting``: over seven tenths of
    its words shout (upper case or ``!!``).  ``repetition``: over three tenths
    of its words equal the word before.  ``boilerplate``: a licence, cookie or
    log-in phrase.  ``punctuation``: no sentence end.
    """

    def facts(ws: Column) -> Column:
        return F.struct(ws.alias("ws"), F.array_join(ws, " ").alias("t"), F.array_join(ws, "").alias("v"))

    def rules(x: Column) -> Column:
        ws, t, v = x["ws"], x["t"], x["v"]
        n, chars = F.size(ws), F.length(v)
        symbols = F.when(v.rlike(f"[{SYMBOLS}]"), chars - F.length(F.translate(v, SYMBOLS, ""))).otherwise(0)
        separators = F.when(t.rlike(SEPARATOR_CHAR), F.size(F.filter(ws, lambda w: w.rlike(SEPARATOR)))).otherwise(0)
        shouts = F.when(t.rlike(SHOUT), F.size(F.filter(ws, lambda w: (F.length(w) > 1) & (
            (w != F.lower(w)) & (w == F.upper(w)) | w.endswith("!!"))))).otherwise(0)
        runs = F.size(F.filter(ws, lambda w, i: (i > 0) & (F.get(ws, i - 1) == w)))
        ends = t.rlike(SENTENCE_END)
        return let(symbols, lambda sym: F.struct(
            t.alias("line"), ws.alias("ws"), n.alias("n"), chars.alias("chars"), sym.alias("symbols"),
            F.when(sym > MAX_SYMBOL_SHARE * chars, "symbols")
            .when((separators > MAX_SEPARATOR_SHARE * n) | ((n < MIN_PROSE_WORDS) & ~ends), "navigation")
            .when((n >= MIN_PROSE_WORDS) & (shouts > MAX_SHOUT_SHARE * n), "shouting")
            .when((n >= MIN_PROSE_WORDS) & (runs > MAX_RUN_SHARE * n), "repetition")
            .when(let(F.lower(t), lambda low: reduce(or_, [low.contains(p) for p in BOILERPLATE])), "boilerplate")
            .when(~ends, "punctuation").alias("rule")))

    return let(let(line_words(line), facts), rules)


def _repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur at least twice, the first included.

    Each window becomes one number: its hash with the low bits replaced by its
    place.  Equal windows are then neighbours after a sort of plain numbers, and
    neighbours are compared word by word.
    """
    n = F.size(ws)
    bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")

    def of(b: Column) -> Column:
        keys = F.transform(F.slice(ws, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.call_function(
            "shiftleft", F.call_function("shiftright", F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)), b), b) + i)

        def place(x: Column) -> Column:
            return F.pmod(x, F.call_function("shiftleft", F.lit(1).cast("long"), b)).cast("int")

        def near(o: Column, x: Column, k: Column) -> Column:
            return F.call_function("shiftright", x, b) == F.call_function("shiftright", F.get(o, k), b)

        def equal(o: Column, x: Column, k: Column) -> Column:
            p, q = place(x), place(F.get(o, k))
            return (F.get(ws, p) == F.get(ws, q)) & (F.get(ws, p + 1) == F.get(ws, q + 1)) & (F.get(ws, p + 2) == F.get(ws, q + 2))

        def side(o: Column, x: Column, k: Column, step: int) -> Column:  # the second neighbour: a collision may stand between
            return near(o, x, k + step) & (equal(o, x, k + step) | near(o, x, k + 2 * step) & equal(o, x, k + 2 * step))

        def starts(o: Column) -> Column:
            found = F.filter(o, lambda x, k: F.coalesce(side(o, x, k, -1), F.lit(False)) | F.coalesce(side(o, x, k, 1), F.lit(False)))
            return F.sort_array(F.transform(found, place))

        return let(let(F.sort_array(keys), starts), covered)

    def covered(s: Column) -> Column:
        return F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]

    return let(bits, of)


def _assessed(text: Column, max_lost: float) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def total(js: Column, field: str) -> Column:
        return F.aggregate(js, F.lit(0), lambda a, x: a + x[field])

    def verdict(x: Column) -> Column:
        js, n = x["js"], x["n"]
        lost = F.aggregate(js, F.lit(0), lambda a, j: a + F.when(j["rule"].isNull(), 0).otherwise(j["n"]))
        names = F.transform(F.filter(js, lambda j: j["rule"].isNotNull()), lambda j: j["rule"])
        return let(lost, lambda gone: F.struct(
            n.cast("long").alias("n_words"), total(js, "chars").cast("long").alias("word_chars"),
            total(js, "symbols").cast("long").alias("n_symbols"), x["dup"].cast("long").alias("n_dup_lines"),
            let(F.flatten(F.transform(js, lambda j: j["ws"])), _repeated_words).cast("long").alias("n_repeat_words"),
            F.concat_ws("\n", F.transform(F.filter(js, lambda j: j["rule"].isNull()), lambda j: j["line"])).alias("clean_text"),
            F.map_from_entries(F.transform(F.array_distinct(names), lambda r: F.struct(
                r, F.size(F.filter(names, lambda y: y == r))))).alias("failed"),
            gone.cast("long").alias("lost_words"),
            ((n > 0) & (gone <= max_lost * n) & (gone < n)).alias("keep")))

    def of(ls: Column) -> Column:
        return let(F.transform(ls, _judged), lambda js: F.struct(
            js.alias("js"), total(js, "n").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))

    return let(let(lines, of), verdict)


def assess(docs: DataFrame, max_lost: float = MAX_LOST_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that pass the rules, counts over the whole text, and a verdict.

    Returns one row per input row: the id; over the whole text ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``;
    ``clean_text`` (the lines that pass, words joined by blanks, lines by line
    feeds), ``failed`` (map from rule to number of lines), ``lost_words`` and
    ``keep``: at most ``max_lost`` of the words were lost and a word is left.

    Lines without a word are dropped and count for nothing.  A null or empty
    text gives zeros, an empty text and ``keep`` false.  Null ids and repeated
    rows are kept as they are, other columns of any name are not looked at, an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a generator evaluates the record once; a projection would do so for every field taken from it
    return docs.select(F.col(id_col), F.inline(F.array(_assessed(text, max_lost))))
