from pyspark.sql import functions as F

from codeweave.functions import imports


def names(spark, parse, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(parse(F.col("t"))).collect()]


def test_names_beyond_ascii_and_other_white_space(spark):
    assert names(spark, imports.python_import, "from módulo import x", "\timport é.b as c,\td\n") == [["x", "módulo.x"], ["é.b", "d"]]
    assert names(spark, imports.java_import, "import com.übung.Klasse;", "\n\timport static a.b.C;", "import a.b.*;\t") == [["Klasse", "com.übung.Klasse"], ["C", "a.b.C"], []]
    assert names(spark, imports.typescript_import, "\tName |./mod") == [["Name"]]
