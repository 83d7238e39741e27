import re
from collections import Counter

import corpus_pipeline
from tidemark.llm import mixing, pieces, toxic

from .fixtures import documents
from .test_exact_near import BLANK, brute_components
from .test_mixing_urls_chat import simulate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder):
    rows = [(k, t, lang, source, len(t or "")) for k, (_, t, lang, source, *_) in enumerate(documents(seed=4, n=80))]
    rows += [(1000 + k, f"some vileword{k % 3} here {'clean words ' * (k % 5)}{k}", "en", "src0", 40) for k in range(60)]
    rows += [(2000 + k, f"some kind words here {'clean words ' * (k % 5)}{k}", "en", "src1", 40) for k in range(300)]
    labels = [(r[0], 1, int("vileword" in (r[1] or ""))) for r in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_match_brute_force(spark, tmp_path):
    folder = str(tmp_path / "data")
    rows = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    out = []
    for k, f in enumerate(stages):
        f(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
        if k < len(stages) - 1:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    # toxic documents go, clean ones stay
    marked = toxic.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    clean = {r.doc_id for r in marked if not r.predicted}
    kept = [r for r in rows if r[0] in clean]
    assert {r.doc_id for r in out[0].collect()} == clean
    assert sum("vileword" in (r[1] or "") for r in kept) <= 3 and sum(r[0] >= 2000 for r in kept) == 300
    # of equal texts the longest, then the smallest identifier
    best = {}
    for r in kept:
        key = BLANK.sub("", r[1] or "")
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    assert sorted(r.doc_id for r in out[1].collect()) == sorted(r[0] for r in best.values())
    # the smallest identifier of each near-duplicate component
    left = sorted(best.values())
    _, roots = brute_components(left)
    near = [r for r, c in zip(left, roots) if c == r[0]]
    assert sorted(r.doc_id for r in out[2].collect()) == sorted(r[0] for r in near)
    # every document once, blocks in the order of a slot-by-slot simulation
    counts = Counter(r[3] for r in near)
    order = simulate({s: -(-n // mixing.BLOCK_ROWS) for s, n in counts.items()}, {s: n**0.5 for s, n in counts.items()})
    # the stage's own order: that of its files and of the rows in them, as the last stage gives it
    placed = sorted({(r.mix_file, r.mix_row, r.doc_id, r.source) for r in out[4].collect()})
    got = [x[3] for x in placed]
    assert [x[2] for x in placed] == [r.doc_id for r in mixing.mix(out[2]).orderBy("position").collect()]
    want = []
    for s, j, _ in order:
        want += [s] * min(mixing.BLOCK_ROWS, counts[s] - j * mixing.BLOCK_ROWS)
    assert got == want and sorted(r.doc_id for r in out[3].collect()) == sorted(r[0] for r in near)
    # distinct segmentations that decode to the whole text
    texts = {r[0]: r[1] or "" for r in near}
    back = pieces.decode(out[4]).collect()
    assert {r.doc_id for r in back} == set(texts) and all(r.text == texts[r.doc_id] for r in back)
    assert len({(r.doc_id, tuple(r.ids)) for r in back}) == len(back)
    assert all(re.search(r"\S", texts[d]) is None or n >= 1 for d, n in Counter(r.doc_id for r in back).items())


def test_run_gives_the_last_stage(spark, tmp_path):
    folder = str(tmp_path / "data")
    write(spark, folder)
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "lang", "source", "rank", "ids"} <= set(out.columns) and out.count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
