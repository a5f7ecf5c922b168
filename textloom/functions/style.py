"""Style features of texts: lengths, script shares, punctuation, speech, and tagged words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.kana import fold
from textloom.functions.text import ENDS, plain, sentences, speech_chars

# The window, parts of speech, first persons, and sentence endings that are counted.
WINDOW = 4000
POS = ("名詞", "動詞", "形容詞", "副詞", "助詞", "助動詞", "接続詞", "代名詞", "感動詞")
FUNCTION_POS = ("助詞", "助動詞")
FUNCTION_WORDS = (
    "の", "に", "て", "わ", "が", "で", "と", "た", "も", "な", "だ", "から", "か", "ない", "つ", "れ", "や", "ば", "ん",
    "です", "ず", "よ", "だけ", "まで", "ぬ", "られ", "など", "ね", "たり", "なら",
)
FIRST_PERSON = ("私", "僕", "俺", "わたし", "あたし", "自分", "余", "小生")
ENDINGS = ("である", "だ", "です", "ます", "だろう", "であろう", "らしい", "のだ")
TOKENS = "array<struct<surface:string,pos1:string,pos2:string>>"


def rule_tokens(text: Column) -> Column:
    """The default tagger: words of letters, capitalised ones as proper nouns, digits as numerals."""
    surface = F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}+"), F.lit(0))

    def tag(w: Column) -> Column:
        number, name = w.rlike(r"^\p{N}"), w.rlike(r"^\p{Lu}\p{Ll}+$")
        return F.struct(w.alias("surface"), F.lit("名詞").alias("pos1"), F.when(number, "数詞").when(name, "固有名詞").otherwise("普通名詞").alias("pos2"))

    return F.transform(surface, tag)


def mecab_tokens(text: Column) -> Column:
    """The dictionary tagger, where it is installed."""

    def run(x):
        import fugashi

        tagger = run.__dict__.setdefault("tagger", fugashi.Tagger())
        return None if x is None else [(w.surface, w.feature.pos1, w.feature.pos2) for w in tagger(x)]

    return F.udf(run, TOKENS, useArrow=True)(text)


BASE = (
    "n_chars", "sent_len_mean", "sent_len_var", "kanji_ratio", "hiragana_ratio", "katakana_ratio",
    "kuten_per_1000", "touten_per_1000", "punct_per_1000", "speech_ratio",
)


def prepared(rows: DataFrame, text_col: str, tagger=None, ends: str = ENDS) -> DataFrame:
    """The columns that features are worked out from, each made once: _p, _ss, _lens, and with a tagger _f and _tokens."""
    out = rows.withColumn("_p", plain(F.col(text_col))).withColumn("_ss", sentences(F.col(text_col), ends)).withColumn("_speech", speech_chars(F.col(text_col)))
    lens = F.transform("_ss", lambda s: F.length(s).cast("double"))
    out = out.withColumn("_lens", F.when(F.size("_ss") == 0, F.array(F.lit(0.0))).otherwise(lens))
    if tagger:
        out = out.withColumn("_f", fold(F.col("_p")))
        tail = lambda s: F.regexp_replace(fold(s), f"[{ENDS}]+$", "")
        out = out.withColumn("_tokens", tagger(F.col("_f"))).withColumn("_ends", F.transform("_ss", tail))
        words = F.transform(F.filter("_tokens", lambda t: t["pos1"].isin(*FUNCTION_POS)), lambda t: t["surface"])
        out = out.withColumn("_pos", F.transform("_tokens", lambda t: t["pos1"])).withColumn("_words", words)
    return out


def base_features(ends: str = ENDS, comma: str = "、") -> dict[str, Column]:
    """What needs no tagger, over prepared columns; null for a text without characters."""
    n = F.nullif(F.length("_p"), F.lit(0)).cast("double")
    total = lambda f: F.aggregate("_lens", F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x) / F.size("_lens")
    count = lambda pattern: F.regexp_count("_p", F.lit(pattern)).cast("double")
    stops, commas = count(f"[{ends}]"), count(f"[{comma}]")
    values = (
        n, mean, F.greatest(total(lambda x: x * x) / F.size("_lens") - mean * mean, F.lit(0.0)),
        count("[一-鿿々]") / n, count("[ぁ-ゖゝゞ]") / n, count("[ァ-ヴーヽヾ]") / n,
        stops / n * 1000, commas / n * 1000, (stops + commas) / n * 1000, F.col("_speech") / n,
    )
    return dict(zip(BASE, values))


def word_features() -> dict[str, Column]:
    """Shares of parts of speech and function words, first persons per 1000 characters, and sentence endings, over prepared columns."""
    n, size = F.nullif(F.length("_p"), F.lit(0)), F.greatest(F.size("_tokens"), F.lit(1))
    equal = lambda col, k: (F.size(col) - F.size(F.array_remove(col, k))) / size
    ended = lambda w: F.size(F.filter("_ends", lambda s: F.endswith(s, w))) / F.greatest(F.size("_ss"), F.lit(1))
    out = {f"pos_{k}": equal("_pos", k) for k in POS} | {f"func_{k}": equal("_words", k) for k in FUNCTION_WORDS}
    for w in FIRST_PERSON:
        f = fold(F.lit(w))
        out[f"fp_{w}"] = (F.length("_f") - F.length(F.replace("_f", f, F.lit("")))) / F.length(f) / n * 1000
    return out | {f"end_{e}": ended(fold(F.lit(e))) for e in ENDINGS}


def feature_names(tagged: bool) -> list[str]:
    words = [f"pos_{k}" for k in POS] + [f"func_{k}" for k in FUNCTION_WORDS] + [f"fp_{w}" for w in FIRST_PERSON] + [f"end_{e}" for e in ENDINGS]
    return [*BASE, *(words if tagged else ())]


def windows(text: Column, size: int = WINDOW) -> Column:
    """The text in stretches of whole lines with at least `size` characters each; a short rest joins the last.

    One left-to-right sum over the lines; a text up to `size` stays whole.
    """
    kept = F.regexp_extract_all(text, F.lit("(?s)[^\n]*\n|[^\n]+$"), F.lit(0))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        n = acc["n"] + F.length(F.regexp_replace(line, "^[　 \t\r\n]+|[　 \t\r\n]+$", ""))
        text_ = F.concat(acc["open"], line)
        full = n >= size
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(text_))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(text_).alias("open"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
        )

    def finish(acc: Column) -> Column:
        small = F.length(plain(acc["open"])) < size // 2
        last = F.element_at(acc["done"], -1)
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), F.array(F.concat(last, acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when((F.size(acc["done"]) > 0) & small, joined).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.when(F.length(plain(text)) <= size, F.array(text)).otherwise(F.aggregate(kept, zero, step, finish))


def work_features(works: DataFrame, id_col: str, text_col: str, size: int = WINDOW, tagger=None, ends: str = ENDS, comma: str = "、", only: tuple[str, ...] | None = None) -> DataFrame:
    """(id, features): unweighted means over a work's windows; n_chars is the whole work's, n_chunks only a long work's.

    With `only`, features of those names, and nothing that others alone need is worked out.
    """
    named = [k for k in feature_names(tagger is not None) if only is None or k in only]
    cut = works.select(F.col(id_col).alias("id"), F.length(plain(F.col(text_col))).alias("chars"), F.explode(windows(F.col(text_col), size)).alias("w"))
    values = base_features(ends, comma) | (word_features() if tagger else {})
    each = prepared(cut, "w", tagger, ends).where("_p != ''").select("id", "chars", *[values[k].cast("double").alias(k) for k in named])
    means = each.groupBy("id").agg(F.max("chars").cast("double").alias("chars"), F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(k).alias(k) for k in named])
    whole = [F.col("chars") if k == "n_chars" else F.col(k) for k in named]
    features = F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*whole))
    count = F.map_from_arrays(F.array(F.lit("n_chunks")), F.array(F.col("n")))
    return means.select("id", F.when(F.col("chars") > size, F.map_concat(features, count)).otherwise(features).alias("features"))
