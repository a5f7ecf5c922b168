"""Spelling-variant folding for kana text, as column expressions.

`fold` maps old and new spellings to one form for comparison; `to_modern` gives
readable present-day spelling. All is done by built-in functions: tables by
`translate`, sound changes by `replace` chains whose outputs are never inputs
of a later link, and iteration marks by one pass over the runs of marks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that take a voicing mark, and their voiced forms.
VOICELESS = "かきくけこさしすせそたちつてとはひふへほカキクケコサシスセソタチツテトハヒフヘホ"
VOICED = "がぎぐげござじずぜぞだぢづでどばびぶべぼガギグゲゴザジズゼゾダヂヅデドバビブベボ"
# Small kana, archaic kana, and the ha-row with the object particle.
SMALL = ("っゃゅょぁぃぅぇぉゎッャュョァィゥェォヮ", "つやゆよあいうえおわツヤユヨアイウエオワ")
ARCHAIC = ("ゐゑヰヱぢづヂヅ", "いえイエじずジズ")
HA_ROW = ("はひふへほハヒフヘホをヲ", "わいうえおワイウエオおオ")
# Long vowels written au and eu, by their first character.
LONG_AU = {
    "あ": "お", "か": "こ", "さ": "そ", "た": "と", "な": "の", "は": "ほ", "ま": "も", "や": "よ", "ら": "ろ",
    "わ": "お", "が": "ご", "ざ": "ぞ", "だ": "ど", "ば": "ぼ", "ぱ": "ぽ",
}
LONG_EU = {
    "え": "よ", "け": "きよ", "せ": "しよ", "て": "ちよ", "ね": "によ", "へ": "ひよ", "め": "みよ", "れ": "りよ",
    "げ": "ぎよ", "ぜ": "じよ", "べ": "びよ", "ぺ": "ぴよ",
}
BEFORE_YAU = "きしちにひみりぎじびぴ"
# Old spellings of contracted and long sounds, and the new ones.
CONTRACTED = {
    "きやう": "きょう", "しやう": "しょう", "ちやう": "ちょう", "にやう": "にょう", "ひやう": "ひょう", "みやう": "みょう",
    "りやう": "りょう", "ぎやう": "ぎょう", "じやう": "じょう", "びやう": "びょう", "ぴやう": "ぴょう", "きゆう": "きゅう",
    "しゆう": "しゅう", "ちゆう": "ちゅう", "にゆう": "にゅう", "ひゆう": "ひゅう", "りゆう": "りゅう", "じゆう": "じゅう",
    "けふ": "きょう", "てふ": "ちょう", "せう": "しょう", "けう": "きょう", "てう": "ちょう", "ねう": "にょう", "へう": "ひょう",
    "めう": "みょう", "れう": "りょう", "げう": "ぎょう", "ぜう": "じょう", "べう": "びょう", "さう": "そう", "かう": "こう",
    "たう": "とう", "なう": "のう", "まう": "もう", "やう": "よう", "らう": "ろう", "わう": "おう", "がう": "ごう",
    "ざう": "ぞう", "だう": "どう", "ばう": "ぼう", "ぱう": "ぽう",
}
KANJI = "一-鿿々"
REPEAT, REPEAT_VOICED = "ゝヽ々", "ゞヾ"
#: A noncharacter that stands between a pair and its voiced copy for a moment.
_MARK = "﷐"


def _replaced(s: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, s)


def voiced(c: Column) -> Column:
    """Characters that take the voicing mark, with it; others as they are."""
    return F.translate(c, VOICELESS, VOICED)


def expand_marks(s: Column) -> Column:
    """Iteration marks written out: two-character repeats first, then one-character marks, left to right.

    A run of marks repeats the character before it, voiced from the first voiced
    mark on. A mark with nothing before it stays, and is what the next repeat.
    """
    paired = F.regexp_replace(s, "([^\n])([^\n])／″＼", f"$1$2{_MARK}$1$2")
    paired = F.replace(_replaced(paired, [(_MARK + a, b) for a, b in zip(VOICELESS, VOICED)]), F.lit(_MARK), F.lit(""))
    paired = F.regexp_replace(paired, "([^\n]{2})／＼", "$1$1")
    marks = REPEAT + REPEAT_VOICED
    pieces = F.regexp_extract_all(paired, F.lit(f"(?s)[^{marks}]+[{marks}]*|[{marks}]+"), F.lit(0))

    def written(p: Column) -> Column:
        body = F.regexp_extract(p, f"^(?:[^{marks}]+|.)", 0)
        plain = F.length(F.regexp_extract(p, f"(?s)^(?:[^{marks}]+|.)([{REPEAT}]*)", 1))
        rest = F.length(p) - F.length(body) - plain
        last = F.right(body, F.lit(1))
        return F.concat(body, F.repeat(last, plain), F.repeat(voiced(last), rest))

    return F.array_join(F.transform(pieces, written), "")


def fold_long(s: Column) -> Column:
    """Long vowels: yau after an i-row character, then eu, then au."""
    s = F.regexp_replace(s, f"([{BEFORE_YAU}])やう", "$1よう")
    return _replaced(s, [(k + "う", v + "う") for k, v in [*LONG_EU.items(), *LONG_AU.items()]])


def fold_stages(s: Column) -> dict[str, Column]:
    """The fold after each of its stages, in order; the ha-row must come before long vowels."""
    marks = expand_marks(s)
    small = F.translate(marks, *SMALL)
    archaic = F.translate(small, *ARCHAIC)
    ha = F.translate(archaic, *HA_ROW)
    return {"raw": s, "marks": marks, "small": small, "archaic": archaic, "ha_row": ha, "fold": fold_long(ha)}


def fold(s: Column) -> Column:
    """The form that old and new spellings share; a text without a character that any stage touches is its own."""
    return F.when(~s.rlike(f"[々ぁ-ヿ／＼{_MARK}]"), s).otherwise(fold_stages(s)["fold"])


def to_modern(s: Column) -> Column:
    """Old spelling brought near the present one, particles left alone.

    Longer contracted forms go first; none overlaps the start of another, so
    the chain is one left-to-right pass.
    """
    s = F.translate(expand_marks(s), *ARCHAIC)
    s = _replaced(s, sorted(CONTRACTED.items(), key=lambda p: -len(p[0])))
    for a, b in (("ひ", "い"), ("ふ", "う"), ("ほ", "お")):
        s = F.regexp_replace(s, f"([{KANJI}]){a}", f"$1{b}")
    return _replaced(s, [("いふ", "いう"), ("まふ", "まう")])
