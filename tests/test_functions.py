"""Normalizers and comparators: expected values, edge cases, properties."""

import random

import pytest
from pyspark.sql import functions as F

from entwine.functions import normalize as N
from entwine.functions import similarity as S
from entwine.functions.jaro import jaro_batch, native_jaro


def values(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(fn("c")).collect()]


def scores(spark, fn, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("a"), F.col("b")).alias("s")).collect())]


def test_normalizers(spark):
    assert values(spark, N.normalize_text, ["  The quick  brown fox  ", None, "", "the The", "quick the", "a b\ta c"]) == ["quick brown fox", "", "", "", "quick", "b c"]
    assert values(spark, N.normalize_name, ["ACME INC.", "J. D. Salinger", "x inc llc", "acme,inc", None]) == ["acme", "j d salinger", "x inc", "acme,inc", ""]
    compat = lambda c: N.normalize_name(c, N.NormalizeOptions(compat_initials=True))
    assert values(spark, compat, ["J. D. Salinger"]) == ["j. d. salinger"]
    assert values(spark, N.normalize_address, ["123 Main Street Apt 4", "5 Elm Avenue #4", "9 Park Blvd."]) == ["123 main st", "5 elm ave #4", "9 park blvd."]
    assert values(spark, N.normalize_phone, ["555-123-4567", "+1 (555) 123-4567", "+1-555-789-0123", "12", ""]) == ["+15551234567", "+15551234567", "+1-555-789-0123", "12", ""]
    assert values(spark, N.normalize_email, ["Info@ACME.com", "bad@", ""]) == ["Info@acme.com", "bad@", ""]
    assert values(spark, N.normalize_state, ["New York", "ny", "Ontario", "é", ""]) == ["NY", "NY", "Ontario", "É", ""]
    assert values(spark, N.normalize_zip, ["12345-6789", "K1A 0B1", ""]) == ["12345", "K1A0B1", ""]


def test_comparator_values(spark):
    jw = scores(spark, S.jaro_winkler_similarity, [("martha", "marhta"), ("dixon", "dicksonx"), ("abxyz", "abqrs")])
    assert jw == pytest.approx([0.961111, 0.813333, 0.68], abs=1e-6)
    assert scores(spark, S.jaro_similarity, [("cd bcac", "bed abadb")]) == pytest.approx([0.546958], abs=1e-6)
    assert scores(spark, S.jaccard, [("acme corp of ny", "acme corp"), ("!!!", "???")]) == [0.5, 0.0]
    assert scores(spark, S.contained_in, [("Acme", "ACME Corp")]) == pytest.approx([4 / 9])
    names = [("Acme Corporation", "Acme Corp."), ("Acme Corp", "Globex Corporation"), ("John Smith", "Jon Smith"), ("Stark Industries", "Oscorp Industries"), ("Acme", "Acme Holdings Inc")]
    assert scores(spark, S.name_similarity, names) == pytest.approx([1.0, 0.283333, 0.684, 0.615441, 0.697692], abs=1e-6)
    places = [("123 Main Street", "123 Main St"), ("123 Main St", "124 Main St"), ("123 Main St Apt 4", "123 Main Street"), ("456 Park Avenue", "567 Fifth Avenue"), ("123 Main St.", "123 Main St")]
    assert scores(spark, S.address_similarity, places) == pytest.approx([1.0, 0.132091, 1.0, 0.069579, 0.971667], abs=1e-6)
    mails = [("info@acme.com", "contact@acme.com"), ("info@acme.com", "INFO@ACME.COM"), ("info@acme.com", "info@globex.com")]
    assert scores(spark, S.email_similarity, mails) == pytest.approx([0.771429, 0.99, 0.0], abs=1e-6)
    phones = [("123-456-7890", "(123)456-7890"), ("1234567", "123-4567"), ("555-1234", "999-8888"), ("ext", "none"), ("ext", "5")]
    assert scores(spark, S.phone_similarity, phones) == [1.0, 1.0, 0.0, 1.0, 0.0]
    assert scores(spark, S.zip_similarity, [("12345", "12345-6789"), ("12345", "12399"), ("12345", "19999"), ("1", "2")]) == [0.95, 0.8, 0.5, 0.0]


@pytest.mark.parametrize("name", list(S.FUNCTIONS))
def test_comparator_edges(spark, name):
    got = scores(spark, S.FUNCTIONS[name], [("", ""), (None, None), ("", "x1"), ("x1", None), ("é 1", "é 1"), ("ab 12", "zz 99")])
    assert got[:2] == [1.0, 1.0] and got[2:4] == [0.0, 0.0]
    assert got[4] == pytest.approx(1.0) and 0 <= got[5] <= 1


def test_jaro_against_loops(spark):
    def plain(a: bytes, b: bytes) -> float:
        if a == b:
            return 1.0
        s, t = (b, a) if len(a) > len(b) else (a, b)
        reach = max(0, len(t) // 2 - 1)
        mine, theirs = [], []
        for i, c in enumerate(s):
            for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                if t[j] == c and j not in theirs:
                    mine.append(i)
                    theirs.append(j)
                    break
        m = len(mine)
        if not m:
            return 0.0
        swaps = sum(s[i] != t[j] for i, j in zip(mine, sorted(theirs)))
        return (m / len(a) + m / len(b) + (m - swaps / 2) / m) / 3

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(2000)]
    a, b = [x.encode() for x, _ in pairs], [y.encode() for _, y in pairs]
    assert jaro_batch(a, b).tolist() == pytest.approx([plain(x, y) for x, y in zip(a, b)])
    ascii_pairs = [(x.replace("é", "e"), y.replace("é", "e")) for x, y in pairs[:200]]
    assert scores(spark, native_jaro, ascii_pairs) == pytest.approx([plain(x.encode(), y.encode()) for x, y in ascii_pairs])


def test_symmetric_and_bounded(spark):
    rng = random.Random(5)
    word = lambda: " ".join("".join(rng.choice("abc1") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 4)))
    pairs = [(word(), word()) for _ in range(150)]
    for name in ("ExactMatch", "CaseInsensitiveMatch", "Levenshtein", "Jaccard", "Cosine", "ContainedIn"):
        one, two = scores(spark, S.FUNCTIONS[name], pairs), scores(spark, S.FUNCTIONS[name], [(b, a) for a, b in pairs])
        assert one == pytest.approx(two) and all(0 <= s <= 1 + 1e-9 for s in one)


def test_registry(spark):
    assert S.by_name("EditDistance") == "Levenshtein" and S.by_name("?") == "JaroWinkler"
    assert S.by_field_type("mobile") == "PhoneSimilarity" and S.by_field_type("?") == "JaroWinkler"
    fields = ["email_address", "hotel", "Company", "zip", "city", "work_email"]
    assert [S.infer(f) for f in fields] == ["AddressSimilarity", "PhoneSimilarity", "NameSimilarity", "ZipCodeSimilarity", "JaroWinkler", "EmailSimilarity"]
    assert values(spark, lambda c: S.infer_column(F.col(c)), fields) == [S.infer(f) for f in fields]
