import hashlib
from unicodedata import ucd_3_2_0

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from noticemill.functions.hashing import content_hash, content_text, record_id


def rows(spark, maps):
    data = [(i, m) for i, m in enumerate(maps)]
    return spark.createDataFrame(data, "i int, m map<string,string>").orderBy("i")


def digest(mapping):
    return hashlib.sha256(str(sorted(mapping.items())).encode()).hexdigest()


def test_fixed_cases(spark):
    maps = [
        {"title": "Test", "agency": "A"},
        {},
        {"a": None},
        {"b": "it's", "a": 'say "x"', "c": "it's \"both\""},
        {"p": "tab\t line\n cr\r back\\slash", "q": "nbsp  soft­ zero​"},
        {"x": "été ñ 漢字 😀", "y": "\x00\x1f\x7f\x85 \U000e0001"},
    ]
    texts = [r.t for r in rows(spark, maps).select(content_text("m").alias("t")).collect()]
    assert texts == [str(sorted(m.items())) for m in maps]


# characters both sides' Unicode tables know
known = st.characters(exclude_categories=["Cs", "Cn"]).filter(
    lambda c: ucd_3_2_0.category(c) != "Cn"
)
text = st.text(known, max_size=12)


@settings(
    max_examples=3,
    deadline=None,
    phases=[Phase.generate],
    suppress_health_check=list(HealthCheck),
)
@given(st.lists(st.dictionaries(text, st.none() | text, max_size=4), min_size=60, max_size=60))
def test_any_text(spark, maps):
    got = [r.h for r in rows(spark, maps).select(content_hash("m").alias("h")).collect()]
    assert got == [digest(m) for m in maps]


def test_entry_order_does_not_matter(spark):
    got = rows(spark, [{"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "1", "b": "3"}])
    hashes = [r.h for r in got.select(content_hash("m").alias("h")).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    assert all(len(h) == 64 for h in hashes)


def test_record_id(spark):
    df = spark.createDataFrame([("a", "b:c"), ("a:b", "c")], "n string, s string")
    ids = [r.r for r in df.select(record_id("n", "s").alias("r")).collect()]
    assert ids == [hashlib.sha256(b"a:b:c").hexdigest()] * 2
