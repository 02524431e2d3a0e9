import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import quality, wordbpe
from sluice.llm.common import read

from .helpers import ODD_TEXTS, docs, save
from .test_lines import brute as brute_lines
from .test_search_toxicity import brute_rows
from .test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]


def brute(rows, items):
    """The stages one after the other on lists of (doc_id, text, lang)."""
    verdict = quality.measure([t or "" for _, t, _ in rows], [x for _, _, x in rows], quality.default_paths())["kept"]
    rows = [r for r, k in zip(rows, verdict, strict=True) if k]
    gone = brute_lines([t for _, t, _ in rows], [i for i, _, _ in rows])
    cut = []
    for i, t, x in rows:
        left = "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in gone)
        if left.strip() or not any(d == i for d, _ in gone):
            cut.append((i, left, x))
    fps = {i: brute_fingerprint(t) for i, t, _ in cut}
    first = brute_components([i for i, _, _ in cut], fps)
    rows = [r for r in cut if first[r[0]] == r[0]]
    held = {d for d, *_ in brute_rows(items, [t for _, t, _ in rows])}
    clean = [r for d, r in enumerate(rows) if d not in held]
    library = Tokenizer.from_file(wordbpe.default_path())
    return {i: library.encode(t, add_special_tokens=False).ids for i, t, _ in clean}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    some = read(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(90).collect()
    texts = [r.text for r in some] + [r.text + " one more word" for r in some[:10]] + ODD_TEXTS
    return save(spark, tmp_path_factory.mktemp("pipe"), documents=docs(spark, texts).repartition(3), benchmark=read(spark, "/root/testdata/sf0.001", "benchmark"))


def test_pipeline_equals_brute_force(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "extra", "n_tokens", "ids"}
    got = {r.doc_id: (r.n_tokens, r.ids) for r in out.collect()}
    rows = [(r.doc_id, r.text, r.lang) for r in read(spark, folder, "documents").collect()]
    want = brute(sorted(rows), [(r.item_id, r.text) for r in read(spark, folder, "benchmark").collect()])
    assert {i: ids for i, (_, ids) in got.items()} == want and all(n == len(ids) for n, ids in got.values()) and len(want) > 30


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    empty = read(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, folder)
        assert out.columns == COLUMNS and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0


def test_repeated_and_null_ids_lose_no_text(spark, folder, tmp_path):
    some = [r.text for r in read(spark, folder, "documents").orderBy("doc_id").collect() if quality.measure([r.text or ""], [r.lang], quality.default_paths())["kept"][0]]
    a, b, c, d = sorted(set(some), key=lambda t: -len(t))[:4]
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (None, d)]
    sf = save(spark, tmp_path, documents=docs(spark, [t for _, t in rows], [i for i, _ in rows]), benchmark=read(spark, folder, "benchmark").limit(0))
    out = corpus_pipeline.run(spark, sf).collect()
    library = Tokenizer.from_file(wordbpe.default_path())
    whole = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in ((0, c), (0, d), (1, a), (5, b)))
    assert sorted(r.doc_id or 0 for r in out) == [i for i, _ in whole]
    assert sum(r.n_tokens for r in out) >= 0.8 * sum(len(x) for _, x in whole)


def test_nothing_else_uses_the_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "sluice").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"sluice\.llm|from sluice import llm", p.read_text()), p


def test_registered_queries():
    import __spark_entry__ as entry
    from sluice.llm import queries

    q, sql = entry.queries(), entry.oracle_sql()
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11)) and "pipeline" in q
    assert set(sql) <= set(q) and all(isinstance(x, str) for x in sql.values())
    assert set(queries.ORACLE_SQL) == {"op4_preference_pairs", "op8_warc_shards"}
