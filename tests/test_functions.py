"""Hand-checked values of column functions."""

import hashlib
import uuid

from pyspark.sql import functions as F

from marginalia.functions import identity as I, policies as P, text as T


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(column(F.col("x"))).collect()]


def test_words_and_languages(spark):
    assert one(spark, T.words, "see https://a.b/c well-known x_y ab3 Модель") == [["see", "well-known", "Модель"]]
    assert one(spark, T.language, "модель", "embedding", "BERT-модель", "été", "123", "ёж") == ["russian", "english", "mixed_or_other", "english", "unknown", "russian"]
    assert one(spark, T.chunk_token_count, "a² x٣, क!") == [5]


def test_token_estimates(spark):
    assert one(spark, T.estimated_tokens, "", "  \n", "a", "abcd", "abcde") == [0, 0, 1, 1, 2]


def test_analysis_text(spark):
    assert one(spark, T.analysis_text, "# A **b** [[c]] ![[d.png]] `e`") == [" A b c d.png e"]


def test_point_ids(spark):
    assert one(spark, I.uuid5, "abc", "é") == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("abc", "é")]
    key = lambda x: I.point_key(x, F.lit("h"), F.lit("v"), F.lit(3))
    assert one(spark, key, "p.md", " ") == [hashlib.sha256(b"p.md\0h\0v\x003").hexdigest(), None]


def test_paths(spark):
    assert one(spark, I.note_title, "a/b/Note.one.md", "c.md", "d") == ["Note.one", "c", "d"]
    assert one(spark, I.link_base, "./x/y.md#part", "z^block", "k.MD") == ["x/y", "z", "k.MD"]
    assert one(spark, lambda c: I.path_key(c), "Straße.MD", "ΣΊΣΥΦΟΣ", "ﬁle.md", "µ", "Кириллица.md") == [x.casefold() for x in ("Straße", "ΣΊΣΥΦΟΣ", "ﬁle", "µ", "Кириллица")]


def test_policies(spark):
    assert one(spark, P.query_label, "ab", "123?", "what is it") == ["refuse", "refuse", "rag_qa"]
    assert one(spark, lambda c: P.rewritten(c, F.lit(1)), " a   b ") == ["a b"]
    assert one(spark, lambda c: P.self_check_reason(c, F.lit(0.3), F.lit(1), F.lit(False)), "", "x") == ["empty answer", "low confidence"]


def test_words_are_counted_as_they_are_listed(spark):
    bodies = ["see https://a.b/c_ü?x=1 well-known x_y ab3 Модель", "", "HTTP://X.y ЁЖ ёж жук-bug ²x 漢字 xhttps://z z-https://q -a- _b_ c--d", "http://", "a\u00a0b К3 don't", "日本語 и and МИКС mix-МИКС"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, t string")
    words = T.words(F.col("t"))

    def same(kind):
        return lambda x: x == kind

    listed = df.select("id", F.size(words).alias("n"), *[F.size(F.filter(F.transform(words, T.language), same(k))).alias(k) for k in T.LANGUAGES])
    counted = df.select("id", *T.language_counts(T.word_line(F.col("t"))))
    assert [tuple(r) for r in listed.orderBy("id").collect()] == [tuple(r) for r in counted.orderBy("id").collect()]
