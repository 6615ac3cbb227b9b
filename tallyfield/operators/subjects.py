"""The wording of corporate actions, read as tokens.

A subject such as "Bonus 1:1/Dividend- Rs 2 Per Share" is cut into components, a component into words, numbers
and the marks : % @. Currency words and money dashes carry no meaning and go. What a component says then
follows from which words it has and from the order of tokens: the numbers on either side of a colon, those
on either side of "to", the first one after "@", those that follow "dividend".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[0-9]+(?:[.][0-9]+)?|[a-z]+(?:-[a-z]+)*|[:%@]"
CURRENCY = ("rs", "re", "inr")
#: Kind of action by stems that must all occur, in order of precedence; a set means any of its stems.
# The words that tell an action's kind, in the order in which they are looked for.
MEANINGS: tuple[tuple[str, tuple], ...] = (
    ("bonus_debenture", ("bonus", {"debenture", "ncrps", "preference"})),
    ("demerger", ("demerge",)),
    ("amalgamation", ({"amalgamation", "merger"},)),
    ("capital_reduction", ("capital", "reduction")),
    ("restructuring", ("scheme", "arrangement")),
    ("bonus", ("bonus",)),
    ("consolidation", ("consolidat",)),
    ("split", ({"split", "splt", "subdivision"},)),
    ("rights", ("rights",)),
    ("dividend", ({"dividend", "div"},)),
)
# Kinds whose effect no ratio tells, and what turns a rights issue into one.
UNADJUSTABLE = ("bonus_debenture", "demerger", "amalgamation", "capital_reduction", "restructuring")
NOT_SHARES = ({"partly", "ccps", "debenture", "warrant", "preference"},)


def components(subject: Column) -> Column:
    """The parts of a subject between slashes or free-standing pluses; the dash of a sum of money (5/-) is no slash."""
    return F.filter(F.split(F.regexp_replace(subject, r"/\s*-", " "), r"/|\s[+]\s"), lambda x: F.trim(x) != "")


def tokens(component: Column) -> Column:
    words = F.transform(F.regexp_extract_all(F.lower(component), F.lit(TOKEN), F.lit(0)), lambda t: F.replace(t, F.lit("-"), F.lit("")))
    return F.filter(words, lambda t: ~t.isin(*CURRENCY))


def _says(words: Column, stems: tuple) -> Column:
    """Whether the words have each stem; a short stem (merger, div) must be the whole word."""
    whole = ("merger", "div", "capital", "partly")
    one = lambda s: F.exists(words, lambda t: (t == s) if s in whole else t.startswith(s))
    either = lambda s: reduce(lambda a, b: a | b, [one(x) for x in sorted(s)]) if isinstance(s, set) else one(s)
    return reduce(lambda a, b: a & b, [either(s) for s in stems])


def _number(token: Column) -> Column:
    return token.try_cast("double")


def _after(words: Column, mark: str) -> Column:
    """The first number after a mark, null if either is missing."""
    at = F.array_position(words, mark)
    rest = F.filter(words, lambda t, i: (i >= at) & _number(t).isNotNull())
    return F.when(at > 0, _number(F.get(rest, F.lit(0))))


def _before(words: Column, mark: str) -> Column:
    """The last number before a mark."""
    at = F.array_position(words, mark)
    return F.when(at > 0, _number(F.try_element_at(F.filter(words, lambda t, i: (i < at - 1) & _number(t).isNotNull()), F.lit(-1))))


def _beside(words: Column, mark: str, step: int) -> Column:
    """The number that stands `step` tokens from a mark."""
    at = F.array_position(words, mark).cast("int")
    return F.when(at > 0, _number(F.get(words, at - 1 + step)))


def _dividends(words: Column, face: Column) -> Column:
    """The sum of the amounts that follow a dividend word or come as "per unit (or share) as dividend"; percentages are of the face value."""
    said = ("dividend", "div")
    word = lambda i: F.coalesce(F.get(words, i), F.lit(""))

    def amount(t: Column, i: Column) -> Column:
        follows = word(i - 1).isin(*said)
        ahead = (word(i + 1) == "per") & word(i + 2).isin("unit", "share") & (word(i + 3) == "as") & word(i + 4).isin(*said)
        return F.when(_number(t).isNotNull() & (follows | ahead), F.when(word(i + 1) == "%", _number(t) / 100 * face).otherwise(_number(t)))

    found = F.filter(F.transform(words, amount), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x))


def parse_actions(actions: DataFrame, subject: str = "subject", face_value: Column | None = None) -> DataFrame:
    """One row per component of each subject, with kind, status, terms and price factor.

    Status: parsed; unadjustable (the price moves by what the wording doesn't tell, or rights without an issue
    price or of other instruments); unparsed (a known kind in unknown wording); no_price_effect.
    """
    face = face_value if face_value is not None else F.lit(None).cast("double")
    rows = actions.select("*", F.posexplode(components(F.col(subject))).alias("part", "component")).withColumn("component", F.trim("component"))
    rows = rows.withColumn("__words", tokens(F.col("component")))
    w = F.col("__words")
    rows = rows.withColumn("kind", F.coalesce(*[F.when(_says(w, stems), F.lit(kind)) for kind, stems in MEANINGS], F.lit("other")))
    k = F.col("kind")
    resized = k.isin("split", "consolidation")
    rows = rows.withColumns({
        "ratio_new": F.when(k.isin("bonus", "rights"), _beside(w, ":", -1)), "ratio_held": F.when(k.isin("bonus", "rights"), _beside(w, ":", 1)),
        "from_fv": F.when(resized, _before(w, "to")), "to_fv": F.when(resized, _after(w, "to")),
        "rights_premium": F.when(k == "rights", _after(w, "@")), "dividend_per_share": F.when(k == "dividend", _dividends(w, face)),
    })
    c = F.col
    # what the numbers say goes before the name: a face value that rises is a consolidation
    rows = rows.withColumn("kind", F.when(resized & (c("to_fv") > c("from_fv")), "consolidation").when(resized & (c("to_fv") < c("from_fv")), "split").otherwise(k))
    clear = (
        F.when(k == "bonus", (c("ratio_new") > 0) & (c("ratio_held") > 0)).when(k == "rights", c("ratio_new").isNotNull() & c("ratio_held").isNotNull())
        .when(k == "dividend", c("dividend_per_share").isNotNull()).when(resized, (c("from_fv") > 0) & (c("to_fv") > 0) & (c("from_fv") != c("to_fv")))
    )
    status = (
        F.when(k == "other", "no_price_effect").when(k.isin(*UNADJUSTABLE) | ((k == "rights") & _says(w, NOT_SHARES)), "unadjustable")
        .when(~F.coalesce(clear, F.lit(False)), "unparsed").when((k == "rights") & c("rights_premium").isNull(), "unadjustable").otherwise("parsed")
    )
    rows = rows.withColumn("status", status)
    known = c("status") == "parsed"
    factor = F.when(known & (k == "bonus"), c("ratio_held") / (c("ratio_new") + c("ratio_held"))).when(known & resized, c("to_fv") / c("from_fv"))
    return rows.withColumn("price_factor", factor).drop("__words")
