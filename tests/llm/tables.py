"""Small awkward tables that every text operator has to take."""

import random

from pyspark.sql import types as T

PASSAGE = " ".join(f"passage{i}" for i in range(40))
LINE = "This very line stands in several of the documents."
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators give to their own columns
        *[T.StructField(n, T.StringType()) for n in ("n_words", "score", "kept_text", "ids", "lang_pred", "predicted", "keep", "h1", "line", "fp", "bin", "cell", "words", "ranges")],
    ]
)
ENGLISH = "the of and to in that was with this from have which there their would about other these".split()
FRENCH = "le la les des une dans pour que qui est avec sur pas nous vous elle mais était été".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "er", "ing"]) for _ in range(n)) + "."


def rows():
    """(doc_id, text, lang, source): prose, copies, near copies, shared lines and passages, odd characters,
    NULLs in every column, an empty text, a very long one, and a repeated row."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        words, lang = (FRENCH, "fr") if i % 3 == 0 else (ENGLISH, "en")
        text = "\n".join(sentence(rng, words, rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))
        if i % 7 == 0:
            text += "\n  " + (LINE.upper() if i % 2 else LINE) + "\t"
        if i % 11 == 0:
            text += " " + PASSAGE
        out.append((i, text, lang, f"s{i % 2}"))
    copy = out[4][1]
    near = "word and " + copy
    out += [(100, copy, "en", "s0"), (101, copy, "en", "s0"), (102, near, "en", None), (103, near, None, "s1")]
    out += [(110, None, "en", "s0"), (111, "", None, None), (112, " \t\n\n \r", "fr", "s1"), (113, "123 !!! 456", "en", "s1")]
    out += [(114, "İstanbul ΟΔΟΣ ﬁ é 中文字 😀😀 \x85x\xa0y <|endoftext|> 'tis I'd", "en", "s1"), (115, "###" * 40 + "$$ " * 60, "en", "s0")]
    out += [(116, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "s0"), (117, "x" * 50_000, "en", "s0"), (118, "a b " * 200, "fr", "s1")]
    out += [(None, copy, "en", "s0"), (None, None, None, None), (5, out[5][1], "en", "s1")]
    return out


def documents(spark, of=None):
    return spark.createDataFrame([(d, t, lang, src, None if t is None else len(t), *["other"] * 14) for d, t, lang, src in (rows() if of is None else of)], SCHEMA)


def benchmark(spark, empty=False):
    items = [(0, PASSAGE), (1, "Le La PASSAGE3 passage4 passage5"), (2, ""), (3, None), (None, " ".join(PASSAGE.split()[:12])), (11, " ".join(PASSAGE.upper().split()[5:20])), (12, "nowhere to be found at all in any of these texts")]
    items += [(7, "passage38 passage39")]
    return spark.createDataFrame([] if empty else items, "item_id long, text string")
