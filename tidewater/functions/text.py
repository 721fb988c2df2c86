"""Text expressions; all but Unicode decomposition run in the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import NULL_TOKENS


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def squeeze(c: Column) -> Column:
    """Each run of white space (any Unicode kind) becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def null_tokens(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~F.lower(c).isin(*tokens), c)


def title_case(c: Column) -> Column:
    """Every maximal run of letters starts upper and goes on lower, as in O'Souza, Smith-Jones, 2Nd."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


@F.arrow_udf(StringType())
def _decompose(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKD", x) for x in s.to_pylist()], pa.string())


def normalize_name(c: Column) -> Column:
    """Decomposed, lower-cased, marks dropped, all but a-z and spaces blanked; null becomes ''.

    Python is given nulls for ASCII values, as a condition around it wouldn't keep them from it.
    """
    plain = F.coalesce(c, F.lit(""))
    wide = F.coalesce(_decompose(F.when(plain.rlike(r"[^\x00-\x7F]"), plain)), plain)
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(wide), r"\p{M}+", ""), r"(?U)[^a-z\s]", " "))


def soundex_key(name: Column) -> Column:
    return F.soundex(F.regexp_replace(name, "[^a-z]", ""))


def letter_signature(*parts: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.replace(F.concat(*parts), F.lit(" "), F.lit("")), "")), "")


def metaphone_key(name: Column, strict: bool = False) -> Column:
    """A phonetic key in which each letter's sound depends on two letters before and two after it.

    At a word's edge every membership test succeeds (strict=False), which is how the keys that blocks rely on were
    defined; strict=True makes a missing neighbour belong to nothing.
    """

    def start(w: Column) -> Column:
        rest = lambda k: w.substr(F.lit(k), F.length(w))
        return F.when(w.rlike("^(AE|GN|KN|PN|WR)"), rest(2)).when(w.startswith("X"), F.concat(F.lit("S"), rest(2))).when(w.startswith("WH"), F.concat(F.lit("W"), rest(3))).otherwise(w)

    def sound(w: Column, i: Column) -> Column:
        at = lambda k: F.when(i + k >= 1, w.substr(i + k, F.lit(1))).otherwise(F.lit(""))
        near = F.struct(at(-2).alias("p2"), at(-1).alias("p"), at(0).alias("c"), at(1).alias("n"), at(2).alias("n2"))
        return let(near, lambda x: spoken(i, *(x[f] for f in ("p2", "p", "c", "n", "n2"))))

    def spoken(i: Column, p2: Column, p: Column, c: Column, n: Column, n2: Column) -> Column:
        isin = lambda x, letters: x.isin(*letters) if strict else (x == "") | x.isin(*letters)
        vowel, front = "AEIOU", "EIY"
        eats = lambda d, d_prev, after: (d == "D") & (d_prev != "D") & isin(after, "EYI")  # noqa: E731  a D that takes the next G
        rules = [
            ((p == c) & (c != "C"), F.lit("")),
            (c.isin(*vowel), F.when(i == 1, c).otherwise("")),
            (c == "B", F.when((p == "M") & (n == ""), "").otherwise("B")),
            (c == "C", F.when((n == "I") & (n2 == "A"), "X").when(n == "H", F.when(p == "S", "K").otherwise("X")).when(isin(n, front), F.when(p == "S", "").otherwise("S")).otherwise("K")),
            (c == "D", F.when((n == "G") & isin(n2, "EYI"), "J").otherwise("T")),
            (c == "G", F.when(eats(p, p2, n), "").when(n == "H", F.when(isin(n2, vowel), "K").otherwise("")).when(n == "N", "").when(isin(n, front), "J").otherwise("K")),
            (c == "H", F.when(isin(p, vowel) & ~isin(n, vowel), "").when(isin(p, "CSPTG"), "").otherwise("H")),
            (c.isin(*"FJKLMNR"), c),
            (c == "P", F.when(n == "H", "F").otherwise("P")),
            (c == "Q", F.lit("K")),
            (c == "S", F.when((n == "H") | ((n == "I") & isin(n2, "OA")), "X").otherwise("S")),
            (c == "T", F.when((n == "I") & isin(n2, "OA"), "X").when(n == "H", "0").otherwise("T")),
            (c == "V", F.lit("F")),
            (c.isin("W", "Y"), F.when(isin(n, vowel), c).otherwise("")),
            (c == "X", F.lit("KS")),
            (c == "Z", F.lit("S")),
        ]
        out = F.lit("")
        for test, value in reversed(rules):
            out = F.when(test, value).otherwise(out)
        return out

    keyed = lambda w: F.when(F.length(w) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: sound(w, i)), "")).otherwise("")
    return let(let(F.upper(F.regexp_replace(name, "[^A-Za-z]", "")), start), keyed)
