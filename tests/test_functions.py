import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.functions import text as T
from textloom.functions.translit import BLOCKS, to_iast, to_script, transliterate


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_fold(spark):
    rows = spark.createDataFrame([("Kṛṣṇa",), ("krishna",), ("Śrī",), ("Hari’s",), (None,), ("Ṃ",)], "t string")
    assert [r.x for r in rows.select(T.fold("t").alias("x")).collect()] == ["krsna", "krsna", "sr", "hars", "", "ṃ"]
    assert [r.x for r in rows.select(T.fold("t", strict=False).alias("x")).collect()][-1] == "m"


def test_ref_parts_order(spark):
    refs = ["1.13.40b", "1.2.9", "1.13.40", "1.13.41", "1.2", "1.2.9.1", "x"]
    rows = spark.createDataFrame([(r,) for r in refs], "r string").orderBy(T.ref_parts("r"))
    assert [r.r for r in rows.collect()] == ["x", "1.2", "1.2.9", "1.2.9.1", "1.13.40", "1.13.40b", "1.13.41"]


def test_terms_and_rank(spark):
    assert T.terms("  Kṛṣṇa a the ") == ["krsna", "the"]
    words = T.fold(F.lit("Kṛṣṇa krishnaa, the"))
    assert one(spark, T.term_rank(words, ["krsna"])) == pytest.approx(0.2 / 1.2)
    assert one(spark, T.term_rank(words, [])) == 0
    assert one(spark, T.headline(F.lit("a b Kṛṣṇa c"), ["krsna"])) == "a b «Kṛṣṇa» c"


def test_ground(spark):
    allowed = F.array(F.lit("1.1.2"), F.lit("1.13.40b"))
    got = one(spark, T.ground(F.lit("A [SB 1.1.2] b [SB 9.9.9] c [SB 1.13.40b]"), allowed))
    assert (got.text, got.refs) == ("A [SB 1.1.2] b c [SB 1.13.40b]", ["1.1.2", "1.13.40b"])
    assert one(spark, T.ground(F.lit("A [SB 9.9.9]"), allowed)).text == ""


def test_small_texts(spark):
    assert one(spark, T.clamp_question(F.lit("  a \n\t b "))) == "a b"
    assert one(spark, T.clamp_question(F.lit(None).cast("string"))) == ""
    assert one(spark, T.parse_tags(F.lit(" a, ,b ,"))) == ["a", "b"]
    got = one(spark, T.word_meanings(F.lit("x — y; z-w; none; p—q—r")))
    assert [(g.word, g.meaning) for g in got] == [("x", "y"), ("z-w", ""), ("p", "q—r")]
    assert one(spark, T.latin_digits(F.lit("१२३"))) == "123"
    assert one(spark, T.dedupe_key(F.lit("क  ख\nग ॥ १२ ॥"))) == "क ख ग"
    assert one(spark, T.percent_encode(F.lit("a b/ç"))) == "a%20b/%C3%A7"
    assert one(spark, T.placeholders(F.lit("{b} {a} {b}"))) == ["a", "b"]
    assert one(spark, T.email_error(F.lit("a@b"))) == "invalid"
    assert one(spark, T.error_kind(F.lit("Invalid OTP code"))) == "code"
    assert one(spark, T.error_kind(F.lit("Connection timed out"))) == "network"
    assert one(spark, T.localized(F.create_map(F.lit("en"), F.lit("x")), "ml")) == "x"
    assert one(spark, T.first_present(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), ["z"])) == "1"
    assert one(spark, T.speaker_of(F.lit("tell me, Sanjaya"), [("Sanjaya", "s"), ("me", "m")])) == "s"
    assert len(one(spark, T.deterministic_uuid("n", F.lit("k")))) == 36


def test_scalars(spark):
    day = lambda d: F.lit(d).cast("date")
    assert one(spark, S.day_index(day(dt.date(2026, 1, 10)), F.lit(10))) == 9
    assert one(spark, S.day_index(day(dt.date(2026, 1, 11)), F.lit(10))) == 0
    assert one(spark, S.day_index(day(dt.date(2026, 1, 11)), F.lit(0))) == 0
    assert one(spark, S.next_speed(F.lit(1.0), [0.75, 1.0, 1.25])) == 1.25
    assert one(spark, S.next_speed(F.lit(1.25), [0.75, 1.0, 1.25])) == 0.75
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, S.percent(F.lit(0), F.lit(3))) == 33.33


def test_transliteration(spark):
    assert to_iast("कृष्णः") == "kṛṣṇaḥ"
    assert to_iast("ऋषय ऊचुः") == "ṛṣaya ūcuḥ"
    assert to_script("त्रिसर्गोऽमृषा", "Mlym") == "ത്രിസർഗോഽമൃഷാ"
    for s in (*BLOCKS, "Taml"):
        assert not any("क" <= c <= "ह" for c in to_script("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", s))
    got = spark.createDataFrame([("नमः",), (None,)], "t string").select(transliterate("t", "Latn").alias("x")).collect()
    assert [r.x for r in got] == ["namaḥ", None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="कखगज़़्ािीुूृेैोौंःऽ।॥ अआइ०१a", max_size=20))
def test_transliteration_never_fails(text):
    for s in (*BLOCKS, "Taml", "Latn", "Deva"):
        to_script(text, s)
