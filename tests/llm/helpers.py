"""Small tables with the cases that every operator has to define."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def save(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "It's a Test's test, isn't it?  Ça ÉTÉ 漢字 \x1c x",
    "It's a Test's test, isn't it?  Ça ÉTÉ 漢字 \x1c x",
    "a<|endoftext|>b <|ENDOFTEXT|> c<|startoftext|>",
    "word " * 5000,
    "x" * 20_000 + "ab" * 4000,
    "ΑΣ ΣΑΣ. İI ǅ ﬁ",
]
