from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions import tokens as K
from proofline.sources.markdown import normalize_text


def one(spark, value, **columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_normalize(spark):
    assert one(spark, "Co-\n operate  “x”", n=T.normalize("t"))["n"] == 'Cooperate "x"'
    assert one(spark, "a-\nB  c", n=T.normalize("t"))["n"] == "a- B c"
    assert one(spark, "a \u001c b", n=T.normalize("t"))["n"] == "a \u001c b"
    assert one(spark, None, n=T.normalize("t"))["n"] is None
    assert one(spark, "a-\nb “c”", n=T.normalize("t", T.WHITESPACE_ONLY))["n"] == "a- b “c”"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab-\u00ad\u2010 \n\t“”‘’\u00a0\u2028.É", max_size=20), min_size=1, max_size=40))
def test_normalize_twice_and_in_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.normalize("t").alias("n"), T.normalize(T.normalize("t")).alias("nn")).collect()
    for r in rows:
        assert normalize_text(r["t"]) == r["n"]


def test_exact_count(spark):
    for hay, needle, n in (("aaaa", "aa", 2), ("abc", "", 0), ("", "a", 0), ("a.b.c", ".", 2)):
        assert one(spark, hay, n=T.exact_count("t", F.lit(needle)))["n"] == n


def test_sentences(spark):
    assert one(spark, "Up 0.05. Et al. Foo! b", s=T.split_sentences("t"))["s"] == ["Up 0.05.", "Et al.", "Foo!", "b"]
    assert one(spark, "Only one.", s=T.candidate_spans("t"))["s"] == ["Only one."]


def test_tokens(spark):
    r = one(spark, "x13y 9,000. 45% 'don't stop' \"q  x\" Twenty", r=K.required_tokens("t"))["r"]
    assert r == sorted(["13", "9,000", "45%", "don't stop", "q x", "twenty"])
    assert one(spark, "The United Nations met. New York City", a=K.advisory_terms("t"))["a"] == ["United Nations", "York City"]
    assert one(spark, "Words with-hyphen and 5 words", w=K.content_words("t", 4, ["hyphen"]))["w"] == ["words"]


def test_coverage_of_overlapping_tokens(spark):
    for hay, token, plain, anywhere in (("x1.1.1", "1.1", False, True), ("1.1", "1.1", True, True), ("1.11.1", "1.1", False, False), ("a13 13", "13", True, True), ("", "x", False, False), ("a\\Eb", "\\E", False, False), ("x", "", False, False)):
        r = one(spark, hay, a=K.is_covered("t", F.lit(token)), b=K.is_covered_any_case("t", F.lit(token)))
        assert (r["a"], r["b"]) == (plain, anywhere), (hay, token)


def test_ids_and_sections(spark):
    for value, good in (("abc", True), ("ab", False), ("-abc", False), ("a-b", True), ("abc\n", False)):
        assert one(spark, value, v=T.is_valid_id("t"))["v"] is good
    assert one(spark, "x", v=T.is_weak_section(F.array(F.lit("Related Work")), ["related"]))["v"] is True
    assert one(spark, "x", v=T.is_weak_section(F.array(F.lit("Related Work")), []))["v"] is False


def test_canonical_locators(spark):
    df = spark.sql("select array(named_struct('source', 'default', 'exact', 'a  b', 'markdown', named_struct('line', 3, 'col', 1, 'unit', 'paragraph', 'section', array()), 'pdf', named_struct('page', 2, 'backend', 'mutool-native'))) as l")
    assert df.select(T.canonical_locators("l")).first()[0] == '[{"exact":"a b","markdown":{"column":1,"line":3,"unit":"paragraph"},"pdf":{"backend":"mutool-native","page":2},"source":"default"}]'
