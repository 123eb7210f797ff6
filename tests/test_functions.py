import pytest
from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.functions.pipeline import STAGES, PipelineConfig, process
from lontar.functions.stemming import stem


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, prices", [("Rp 850.000", [850000]), ("Rp 1,5 juta", [1500000]), ("Rp 1,5", []), ("Rp 500.000 atau 500rb", [500000]), ("Mulai Rp 500.000 sampai Rp 1.500.000", [500000, 1500000]), ("", [])])
def test_prices(spark, text, prices):
    assert one(spark, X.extract_prices(F.lit(text))) == prices


@pytest.mark.parametrize("text, price", [("1,5 jt", 1500000), ("Rp 850.000 atau 850k", 850000), ("500 ribu", 500000), ("gratis", None), ("4.1jt", 4099999)])
def test_first_price(spark, text, price):
    assert one(spark, X.extract_price(F.lit(text))) == price


def test_facilities(spark):
    assert one(spark, X.normalize_facilities(F.array(F.lit("AC"), F.lit("a/c"), F.lit("Air Conditioner")))) == ["ac"]
    assert one(spark, X.normalize_facilities(F.array(F.lit(""), F.lit("WiFi"), F.lit("  "), F.lit("2"), F.lit(None)))) == ["wifi"]
    assert one(spark, X.clean_facilities(F.array(F.lit(" AC "), F.lit("AC"), F.lit("7")))) == ["AC"]


def test_text(spark):
    assert one(spark, X.strip_html(F.lit("<p>a &amp; b</p><script>x()</script><!-- c --> d"))) == "a & b d"
    assert one(spark, X.normalize_whitespace(F.lit("\xa0 a \t\n b "))) == "a b"
    assert one(spark, X.clean_lines(F.lit("a  b\n\n  c "))) == "a b\nc"
    assert one(spark, X.word_count(F.lit(None).cast("string"))) == 0
    assert one(spark, X.truncate(F.lit("a" * 300), 10)) == "aaaaaaa..."
    assert one(spark, X.apply_jargon(F.lit("km dlm dan kost kostan"))) == "kamar mandi dalam dan kos kosan"
    assert one(spark, X.correct_spelling(F.lit("fasilitsa rapih"))) == "fasilitas rapi"
    assert one(spark, X.detect_tenant(F.lit("Kos Cewek"))) == "putri"
    parts = (F.lit("Kos A"), F.lit(""), F.array(F.lit("ac")), F.lit("bersih"))
    assert one(spark, X.compose_lexical(*parts)) == "Kos A . Kos A . ac . bersih" and one(spark, X.compose_natural(*parts)) == "Kos A. ac. bersih"


@pytest.mark.parametrize("word, root", [("berlari", "lari"), ("pergi", "pergi"), ("kampusnya", "kampus"), ("membaca", "baca"), ("kos", "kos")])
def test_stem(word, root):
    assert stem(word) == root


def test_pipeline(spark):
    df = spark.createDataFrame([("<b>Kos cowok</b> km dlm Rp 850.000",), ("",), (None,)], "t string")
    full, *empty = df.select(process("t", trace=True).alias("p")).select("p.*").collect()
    assert full.extracted_prices == [850000] and full.stages_applied == list(STAGES) == [s.stage for s in full.trace] and full.tokens[0] == "putra"
    assert all(r.processed == "" and r.tokens == [] and r.stages_applied == [] for r in empty)
    less = df.select(process("t", PipelineConfig(stem=False, remove_stopwords=False, apply_jargon_dict=False)).alias("p")).first().p
    assert less.tokens[:3] == ["kos", "cowok", "km"]
