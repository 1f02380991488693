from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codec, hashing, routing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_string_hash_equals_the_jvm(spark):
    for text, wanted in (("f#key1", -1339182161), ("cf3#key9999", 1987547084), ("业#k{u1}", -951653752), ("", 0)):
        assert one(spark, hashing.string_hash(F.lit(text))) == wanted == hashing.string_hash_literal(text)
    assert one(spark, hashing.spread_hash(F.lit("f#key1"))) == -1339227262
    assert one(spark, hashing.spread_hash(F.lit(None).cast("string"))) == 0


def test_bytes_hash_equals_the_jvm(spark):
    for text, wanted in (("f#key1", -451678480), ("cf3#key9999", 2116629803), ("业#k{u1}", -1282135469)):
        assert one(spark, hashing.bytes_hash(F.lit(text))) == wanted == hashing.bytes_hash_literal(text)


def test_partition_of_a_negative_hash_is_not_negative(spark):
    assert one(spark, hashing.partition_of(F.lit("f#key1"), 17)) == -1339227262 % 17


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs"], exclude_characters="\0"), max_size=12), min_size=1, max_size=20))
def test_hashes_agree_with_their_literal_forms(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.string_hash(F.col("t")).alias("s"), hashing.bytes_hash(F.col("t")).alias("b"), hashing.memory_shard(F.col("t"), F.col("t"), 16).alias("m"))
    for r in frame.collect():
        assert (r.s, r.b, r.m) == (hashing.string_hash_literal(r.t), hashing.bytes_hash_literal(r.t), hashing.memory_shard_literal(r.t, r.t, 16))


def test_codecs(spark):
    assert one(spark, codec.json_text(F.lit('a"b'))) == '"a\\"b"'
    assert one(spark, codec.json_text(F.lit(None).cast("string"))) == "null"
    assert one(spark, codec.json_text(F.lit(5))) == "5"
    assert one(spark, codec.cell_key(F.lit("f"), F.lit("k"), F.lit("c"))) == '"f#k#c"'
    assert one(spark, codec.long_bytes(F.lit(1234567890).cast("long"))) == (1234567890).to_bytes(8, "little").hex().upper()
    assert tuple(one(spark, codec.parse_trp(F.lit("a_b_c_2_7")))) == ("a_b_c", 2, 7)
    assert tuple(one(spark, codec.endpoint(F.lit("10.0.0.1:9000")))) == ("10.0.0.1", 9000)
    assert codec.bloom_size(1_000_000, 0.01) == (9585058, 7)
    assert [one(spark, codec.power_of_two(F.lit(n))) for n in (1, 2, 3, 17)] == [1, 2, 4, 32]
    assert tuple(one(spark, codec.envelope(F.lit(True), F.lit(500), F.lit("bad")))) == (False, 500, "bad")
    assert tuple(one(spark, codec.envelope(F.lit(False), F.lit(500), F.lit("bad")))) == (True, 0, "success")


def test_strategies(spark):
    def route(text, key):
        return one(spark, routing.parse(text)(F.lit("t"), F.lit(key), F.lit("f"), F.lit("c")))

    assert route("brace", "user:{7}:x") == "7" and route("brace", "{}") == "" and route("brace", "plain") == "plain"
    assert route("colon", "a:b:c") == "c" and route("colon", "a:") == "" and route("colon", "plain") == "plain"
    assert route("prefix:2", "a:b:c") == "a:b" and route("full_key", "k") == "t#k#f#c"
    assert route(r"regex:(user_\d+)", "x user_12") == "user_12"
    both = routing.composite(routing.brace(), routing.colon())
    assert one(spark, both(F.lit("t"), F.lit("{}:"), F.lit("f"), F.lit("c"))) == "{}:"


def test_bloom_filter_never_misses_a_key(spark):
    from tessera.functions.bloom import KeyFilter

    found = KeyFilter(spark.range(10_000).select(F.col("id").cast("string").alias("k")), "k", 20_000, 0.01)
    assert all(found.might_contain(str(i)) for i in range(10_000))
    assert sum(found.might_contain(f"other{i}") for i in range(2_000)) < 100
    assert not found.might_contain("key1")
    found.add("key1")
    other = KeyFilter(spark.createDataFrame([("业务",), (None,)], "k string"), "k", 20_000, 0.01)
    assert found.might_contain("key1") and found.merge(other).might_contain("业务")
    frame = spark.createDataFrame([("17",), ("业务",), ("other1",), (None,)], "k string")
    assert {r.k for r in found.passing(frame, "k").collect()} >= {"17", "业务"} and found.passing(frame.where("k IS NULL"), "k").count() == 0
    assert [r.k for r in found.passing(frame, "k").collect() if not found.might_contain(r.k)] == []


def test_string_hash_folds_utf16_units(spark):
    def jvm(text):
        units, h = text.encode("utf-16-be"), 0
        for at in range(0, len(units), 2):
            h = (31 * h + int.from_bytes(units[at : at + 2])) % 2**32
        return h - 2**32 if h >= 2**31 else h

    for text in ("", "key1", "业务", "a\U0001f600b", "\U0010ffff\U00010000"):
        expected = spark._jvm.java.util.Objects.hashCode(text)
        assert one(spark, hashing.string_hash(F.lit(text))) == hashing.string_hash_literal(text) == jvm(text) == expected
