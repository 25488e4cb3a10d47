import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "cited"),
    [
        ("answer [P1, P3]", ["P1", "P3"]),
        ("answer [P1][P3]", ["P1", "P3"]),
        ("answer [P3; P1] [P3]", ["P3", "P1"]),
        ("see [note 3]", []),
        ("x [P11]", ["P11"]),
        ("", []),
    ],
)
def test_citations(spark, text, cited):
    assert one(spark, text, T.cited_aliases("t")) == cited


@pytest.mark.parametrize(("text", "bare"), [("[P1, P2] yes", "yes"), ("Blueport.", "Blueport"), ("a  b [P1].", "a b")])
def test_strip(spark, text, bare):
    assert one(spark, text, T.strip_citations("t")) == bare


@pytest.mark.parametrize(
    ("pred", "gold", "em", "f1"),
    [("The Blue Port!", "blue port", 1, 1.0), ("yes", "no", 0, 0.0), ("", "", 1, 1.0), ("", "x", 0, 0.0), ("red blue blue", "blue green", 0, 0.4)],
)
def test_em_f1(spark, pred, gold, em, f1):
    r = spark.createDataFrame([(pred, gold)], "p string, g string").select(T.exact_match("p", "g").alias("em"), T.f1("p", "g").alias("f1")).first()
    assert (r["em"], round(r["f1"], 6)) == (em, f1)


def test_padding_keeps_long_numbers(spark):
    df = spark.createDataFrame([(3,), (42,), (100,)], "i int").select(T.padded("i", 2).alias("p"))
    assert [r["p"] for r in df.collect()] == ["03", "42", "100"]


def test_unit_hash(spark):
    assert one(spark, "t:x", T.hash_unit(F.col("t"))) == pytest.approx(0.9038907970590085)


def test_normalize_title_equals_python(spark):
    import unicodedata

    from plumbline.plans import text as P
    from plumbline.sources import fixture as V

    sf = "/root/testdata/sf0.001"
    titles = {r["pid"]: r["title"] for r in V.passages(spark, sf).select("pid", "title").collect()}
    want = {pid: " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for pid, t in titles.items() if t is not None}
    assert {r["pid"]: r["norm"] for r in P.normalize_title(spark, sf).collect()} == want and len(want) > 100
    assert P.canonical(__import__("pandas").Series(["ﬁ　 ①\tStraße ", None])).tolist() == ["fi 1 Straße", None]


def test_tree_digest(spark):
    import hashlib
    from collections import defaultdict

    rows = [("ab"[i % 2], f"line {i // 3}") for i in range(600)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for group in "ab":
        ranges = defaultdict(list)
        for g, line in rows:
            if g == group:
                ranges[sha(line)[:2]].append(line)
        want[group] = (len(ranges), sha("\n".join(f"{k}:{sha(chr(10).join(sorted(v)))}" for k, v in sorted(ranges.items()))))
    df = spark.createDataFrame(rows, "g string, line string").withColumn("h", F.sha2("line", 256))
    for same in (df, df.orderBy(F.rand(3)).repartition(7)):
        assert {r["g"]: (r["buckets"], r["digest"]) for r in T.tree_digest(same, "g", 2).collect()} == want
    assert T.tree_digest(df.limit(0), "g").collect() == []
