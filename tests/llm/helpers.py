"""Small tables for the tests of the training-data operators."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside, with other contents.
CLASHING = "id string, node string, n string, token string, klass string, label string, score string, length string, _id string"


def docs_of(spark, rows, extra=True):
    """(doc_id, text) rows as a documents-like table with clashing columns."""
    schema = "doc_id long, text string" + (", " + CLASHING if extra else "")
    width = len(T._parse_datatype_string(schema).fields) - 2
    return spark.createDataFrame([(*r, *["x"] * width) for r in rows], schema)


#: null, empty, blank, short, repeated, unusual and long texts
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "Le mot juste, déjà vu."), (5, "Le mot juste, déjà vu."),
       (6, "x" * 5000), (7, "one two three " * 3000), (8, "日本語 テキスト　全角 ​ zero"), (9, "<|endoftext|> a b\r\nc"),
       (None, "no id"), (10, "\x1c\x85odd\x0b white \x0c")]
