"""Words of a text, folded and stemmed.

The stemmer is Porter's (1980, with his later ``logi`` and ``bli``), as projections
of column expressions: each step looks for its longest suffix and tests the rest
of the word by a regular expression. Words of fewer than three or more than 64
bytes stay as they are."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and what they are folded to (fixed values).
ACCENTED, FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
WORD, SEPARATORS = r"[a-z0-9\p{L}]+", r"[^a-z0-9\p{L}]+"

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Tests of a stem: a vowel, one or more, exactly one, two or more vowel-consonant pairs; short (consonant, vowel, consonant but w, x, y).
VOWEL = f"^({_C})?[aeiouy]"
ONE = f"^({_C})?{_V}{_C}"
JUST_ONE = f"^({_C})?{_V}{_C}({_V})?$"
TWO = f"^({_C})?{_V}{_C}{_V}{_C}"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"

# fixed values: suffixes and what takes their place
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def words(text: Column) -> Column:
    """The words of letters and digits of a text, lower-cased and without accents, in order."""
    # taken out by what they have: to split by what they haven't takes many times as long
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, FOLDED), F.lit(f"({WORD})"))


def spaced(text: Column) -> Column:
    """The ``words`` of a text as one string, with a blank between two and perhaps at either end."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, FOLDED), SEPARATORS, " ")


def _before(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _longest(rules):
    return sorted(rules, key=lambda r: -len(r[0]))


def _step(w: Column, rules: tuple[tuple[str, str], ...], test: str | None) -> Column:
    out = None
    for suffix, other in _longest(rules):
        stem = _before(w, suffix)
        new = F.concat(stem, F.lit(other))
        if test:
            good = stem.rlike(test) & stem.rlike("[st]$") if suffix == "ion" else stem.rlike(test)
            new = F.when(good, new).otherwise(w)
        out = F.when(w.endswith(suffix), new) if out is None else out.when(w.endswith(suffix), new)
    return out.otherwise(w)


def add_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """Adds ``out``, the stem of the lower-case ``word``.

    A step is a projection of its own, as it names the one before many times."""
    w = F.col("__w")
    fit = (F.octet_length(F.col(word)) >= 3) & (F.octet_length(F.col(word)) <= 64)
    d = df.withColumn("__w", F.when(fit, F.col(word))).withColumn("__w", _step(w, STEP_1A, None))
    cut = F.when(w.endswith("ed") & _before(w, "ed").rlike(VOWEL), 2).when(w.endswith("ing") & _before(w, "ing").rlike(VOWEL), 3)
    d = d.withColumn("__cut", F.when(w.endswith("eed"), 0).otherwise(F.coalesce(cut, F.lit(0))))
    d = d.withColumn("__w", F.when(w.endswith("eed") & _before(w, "eed").rlike(ONE), _before(w, "d")).otherwise(F.substring(w, F.lit(1), F.length(w) - F.col("__cut"))))
    double = (F.substring(w, -1, 1) == F.substring(w, F.length(w) - 1, F.lit(1))) & w.rlike("[^aeiouylsz]$") & (F.length(w) > 1)
    mended = F.when(w.rlike("(at|bl|iz)$") | (~double & w.rlike(JUST_ONE) & w.rlike(SHORT)), F.concat(w, F.lit("e"))).when(double, _before(w, "x")).otherwise(w)
    d = d.withColumn("__w", F.when(F.col("__cut") > 0, mended).otherwise(w))
    d = d.withColumn("__w", F.when(w.endswith("y") & _before(w, "y").rlike(VOWEL), F.concat(_before(w, "y"), F.lit("i"))).otherwise(w))
    d = d.withColumn("__w", _step(w, STEP_2, ONE)).withColumn("__w", _step(w, STEP_3, ONE))
    d = d.withColumn("__w", _step(w, tuple((s, "") for s in STEP_4), TWO))
    stem = _before(w, "e")
    d = d.withColumn("__w", F.when(w.endswith("e") & (stem.rlike(TWO) | (stem.rlike(JUST_ONE) & ~stem.rlike(SHORT))), stem).otherwise(w))
    return d.withColumn(out, F.coalesce(F.when(w.endswith("ll") & w.rlike(TWO), _before(w, "l")).otherwise(w), F.col(word))).drop("__w", "__cut")


def _ended(w: str, rules: list[tuple[str, str]], ends: tuple[str, ...], test: str | None) -> str:
    for suffix, other in rules if w.endswith(ends) else ():
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            good = not test or (re.search(test, stem) and (suffix != "ion" or stem[-1] in "st"))
            return stem + other if good else w
    return w


_STEPS = [(_longest(rules), tuple(s for s, _ in rules), test) for rules, test in ((STEP_1A, None), (STEP_2, ONE), (STEP_3, ONE), (tuple((s, "") for s in STEP_4), TWO))]
#: A word without any of these ends stays as it is.
_ENDS = tuple({s for _, ends, _ in _STEPS for s in ends} | {"ed", "ing", "y", "e", "ll"})


@lru_cache(1 << 18)
def stem_of(word: str) -> str:
    """The stem that ``add_stem`` gives, of one word."""
    if not word.endswith(_ENDS) or not 3 <= len(word.encode()) <= 64:
        return word
    w, has = _ended(word, *_STEPS[0]), lambda test, x: re.search(test, x) is not None
    if w.endswith("eed"):
        w = w[:-1] if has(ONE, w[:-3]) else w
    else:
        cut = 2 if w.endswith("ed") and has(VOWEL, w[:-2]) else 3 if w.endswith("ing") and has(VOWEL, w[:-3]) else 0
        if cut:
            w = w[:-cut]
            double = len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz"
            if w.endswith(("at", "bl", "iz")) or (not double and has(JUST_ONE, w) and has(SHORT, w)):
                w += "e"
            elif double:
                w = w[:-1]
    if w.endswith("y") and has(VOWEL, w[:-1]):
        w = w[:-1] + "i"
    for step in _STEPS[1:]:
        w = _ended(w, *step)
    if w.endswith("e") and (has(TWO, w[:-1]) or (has(JUST_ONE, w[:-1]) and not has(SHORT, w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and has(TWO, w) else w


def stem_sql(source: str, word: str, out: str) -> str:
    """The same as one DuckDB select over ``source``, with the columns of it and ``out``."""

    def before(n: int) -> str:
        return f"left(w, -{n})" if n else "w"

    def step(rules, test: str | None) -> str:
        cases = []
        for suffix, other in _longest(rules):
            stem = before(len(suffix))
            also = f" AND regexp_matches({stem}, '[st]$')" if suffix == "ion" and test else ""
            new = f"CASE WHEN regexp_matches({stem}, '{test}'){also} THEN {stem} || '{other}' ELSE w END" if test else f"{stem} || '{other}'"
            cases.append(f"WHEN ends_with(w, '{suffix}') THEN {new}")
        return f"CASE {' '.join(cases)} ELSE w END"

    vowel = lambda n: f"regexp_matches({before(n)}, '{VOWEL}')"
    double = "(w[-1:] = w[-2:-2] AND regexp_matches(w, '[^aeiouylsz]$') AND length(w) > 1)"
    q = f"SELECT *, CASE WHEN strlen({word}) BETWEEN 3 AND 64 THEN {word} END AS w FROM {source}"
    q = f"SELECT * REPLACE ({step(STEP_1A, None)} AS w) FROM ({q})"
    q = f"SELECT *, CASE WHEN ends_with(w, 'eed') THEN 0 WHEN ends_with(w, 'ed') AND {vowel(2)} THEN 2 WHEN ends_with(w, 'ing') AND {vowel(3)} THEN 3 ELSE 0 END AS cut FROM ({q})"
    q = f"SELECT * REPLACE (CASE WHEN ends_with(w, 'eed') AND regexp_matches({before(3)}, '{ONE}') THEN {before(1)} ELSE left(w, length(w) - cut) END AS w) FROM ({q})"
    q = f"SELECT * REPLACE (CASE WHEN cut = 0 THEN w WHEN regexp_matches(w, '(at|bl|iz)$') OR (NOT {double} AND regexp_matches(w, '{JUST_ONE}') AND regexp_matches(w, '{SHORT}')) THEN w || 'e' WHEN {double} THEN {before(1)} ELSE w END AS w) FROM ({q})"
    q = f"SELECT * REPLACE (CASE WHEN ends_with(w, 'y') AND {vowel(1)} THEN {before(1)} || 'i' ELSE w END AS w) FROM ({q})"
    for rules, test in ((STEP_2, ONE), (STEP_3, ONE), (tuple((s, "") for s in STEP_4), TWO)):
        q = f"SELECT * REPLACE ({step(rules, test)} AS w) FROM ({q})"
    q = f"SELECT * REPLACE (CASE WHEN ends_with(w, 'e') AND (regexp_matches({before(1)}, '{TWO}') OR (regexp_matches({before(1)}, '{JUST_ONE}') AND NOT regexp_matches({before(1)}, '{SHORT}'))) THEN {before(1)} ELSE w END AS w) FROM ({q})"
    return f"SELECT * EXCLUDE (w, cut), coalesce(CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{TWO}') THEN {before(1)} ELSE w END, {word}) AS {out} FROM ({q})"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({text}, '')), '{ACCENTED}', '{FOLDED}'), '{SEPARATORS}'), lambda w: w <> '')"
