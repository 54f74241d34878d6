from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_langid import FIXED, documents
from tests.llm.test_neardup import brute as classes


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = documents(200, seed=4)
    long = [(i, f"{t} {i} " + " ".join(f"{w}{i}x{j}" for j, w in enumerate(FIXED[lang] * 4)), lang) for i, t, lang in rows]
    copies = [(500 + i, t, lang) for i, t, lang in long[:20]]
    items = [(i, " ".join(f"item{i}w{j}" for j in range(10))) for i in range(4)]
    leaks = [(600 + i, f"kato miru {items[0][1]} {items[1][1]} tan {i}", "aa") for i in range(5)]
    docs = long + copies + leaks + [(700, None, "aa"), (701, "123 !!", "bb"), (702, f"oxy zeph qir {items[2][1]}", "cc")]
    docs = [(d, t, lang, f"s{d % 3}", len(t or "")) for d, t, lang in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_each_stage_against_its_own_input(spark, tables):
    path, rows, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        where = f"{path}/{name}.parquet"
        out.write.parquet(where)
        docs = spark.read.parquet(where)
        outs.append(docs.collect())
    ids = [[r.doc_id for r in x] for x in outs]
    assert sorted(ids[0]) == sorted(r[0] for r in rows if r[0] not in (700, 701))
    by_text = [(r.doc_id, r.text) for r in outs[0]]
    assert sorted(ids[1]) == sorted({c for _, c in classes(by_text)})
    bad = contaminated([(r.doc_id, r.text) for r in outs[1]], items)
    assert sorted(ids[2]) == sorted(d for d, v in bad.items() if not v[2])  # clean ones stay, one-item and two-item leaks go
    assert {702, 600} <= set(ids[1]) and not set(ids[2]) & {702, *range(600, 605)}
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 3
    assert Counter(ids[4]) == Counter(ids[3])
    sizes = Counter(r.shard for r in outs[4])
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1


def test_run_applies_the_stages(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
