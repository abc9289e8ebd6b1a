import pyarrow as pa
import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in zip(ids, texts, langs)], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def save(folder, **tables):
    for name, data in tables.items():
        pq.write_table(pa.table(data), f"{folder}/{name}.parquet")
    return str(folder)
