"""Documents with every odd case: nulls, empty, long and repeated texts, ties, columns with clashing names."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = T.StructType([*DOCUMENTS.fields, *[T.StructField(c, T.StringType()) for c in (
    "k", "t", "fp", "node", "lot", "component_id", "kept", "score", "posterior", "start", "length", "offset", "part")]])

PROSE = ("The river ran past the old mill and the people of the town came down to it in the evening to talk about the "
         "harvest and the weather while the children played near the water until it was dark")
FRENCH = "Le chat est sur la table et les enfants sont dans le jardin avec une petite fille qui chante pour nous"


def texts() -> list[tuple[int | None, str | None]]:
    other = " ".join(f"word{i} of number {i * 7}" for i in range(60))
    return [
        (0, PROSE), (1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (5, " \t\n "), (6, "a"), (7, "Ünïcode — 漢字 🙂 don't"),
        (8, other), (9, other + " tail"), (10, f"{other} {PROSE} {other}"), (11, FRENCH), (11, FRENCH), (12, FRENCH + "."),
        (13, "long " * 30_000), (14, "x" * 100_000), (None, PROSE), (None, None), (15, "12 34 !!"), (16, "a\x00b\x1f c"),
    ]


def rows(extra: int = 0) -> list[tuple]:
    out = []
    for i, (key, text) in enumerate(texts()):
        lang = [None, "en", "fr", "", "not a code"][i % 5]
        source = [None, "a.example.com", "b.example.com", "src", ""][i % 5]
        out.append((key, text, lang, source, None if text is None else len(text), *["clash"] * extra))
    return out


def documents(spark, clashing: bool = False):
    return spark.createDataFrame(rows(13 if clashing else 0), CLASHING if clashing else DOCUMENTS)


def none_at_all(spark):
    return spark.createDataFrame([], DOCUMENTS)
