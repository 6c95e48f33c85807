import random
from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
from millrace.llm import quality
from millrace.llm.queries import ORACLES, QUERIES, tokenizer_path
from tokenizers import Tokenizer


def fixture_rows():
    """Good and poor texts, near copies and a passage that recurs in unlike texts, all ASCII."""
    rng = random.Random(11)

    def prose(n):
        return [f"{rng.choice(['ba', 'ce', 'di', 'fo', 'gu'])}{rng.choice(['lan', 'mer', 'nos', 'pit', 'rud'])}{rng.randrange(30)}" for _ in range(n)]

    passage = " ".join(prose(70))
    texts = []
    for _ in range(40):
        base = prose(rng.randrange(90, 200))
        texts.append(" ".join(base))
        if rng.random() < 0.4:
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        if rng.random() < 0.3:
            texts.append(f"{' '.join(prose(120))} {passage} {' '.join(prose(100))}")
    poor = [" ".join(rng.choice(["BUY!!", "$$$", "##", "CLICK", "x9"]) for _ in range(rng.randrange(20, 80))) for _ in range(30)]
    rows = [(t, 1) for t in texts] + [(t, 0) for t in poor]
    rng.shuffle(rows)
    return [(k, t, rng.choice(["a", "b", "c", None]), q if rng.random() < 0.8 else None) for k, (t, q) in enumerate(rows)]


def plain_good(rows, model):
    def level(share):
        return sum(share >= x for x in quality.LEVELS)

    for key, text, source in rows:
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        own = {f"w:{quality._edge.sub('', w).lower()}" for w in words}
        own |= {f"s:{s}:{level(n / len(words))}" for s, n in Counter(map(quality.shape, words)).items()}
        own |= {f"again:{level(sum(x == y for x, y in zip(words, words[1:])) / (len(words) - 1))}", f"fresh:{int(8 * len(set(words)) / len(words)) if len(words) >= 20 else 9}", f"lines:{level(1 - len(set(lines)) / len(lines))}"}
        score = sum(float(model.weights[b]) for b in {quality.bucket(x) for x in own})
        if score - model.thresholds[-1] >= -2.1972245773:  # the logit of 0.1
            yield key, text, source


def plain_distinct(rows):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [shingles(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min((r for r, g in zip(rows, group, strict=True) if g == own), key=lambda r: r[0]) for own in set(group)]


def plain_without_repeats(rows, length=corpus_pipeline.PASSAGE):
    seen = Counter(t[p : p + length] for _, t, _ in rows for p in range(len(t) - length + 1))
    for key, text, source in rows:
        gone = {q for p in range(len(text) - length + 1) if seen[text[p : p + length]] > 1 for q in range(p, p + length)}
        yield key, "".join(c for p, c in enumerate(text) if p not in gone), source


def plain_mixed(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    times = {r[0]: r[4] // r[1] for r in con.execute(ORACLES["op4_mixing"]).fetchall() if r[1]}
    return [r for r in rows for _ in range(times.get(r[0], 0))]


def test_rows_of_every_stage_equal_a_plain_computation(spark, tmp_path):
    rows = fixture_rows()
    spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, _, _, q in rows if q is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want, sizes = [r[:3] for r in rows], []
    plain = [lambda x: plain_good(x, model), plain_distinct, plain_without_repeats, plain_mixed]
    for (name, stage), simple in zip(corpus_pipeline.STAGES, plain, strict=False):
        docs, want = corpus_pipeline.written(stage(spark, docs, str(tmp_path))), list(simple(want))
        got = docs.collect()
        assert sorted(((r.doc_id, r.text, r.source) for r in got), key=str) == sorted(want, key=str), name
        assert all(r.n_chars == len(r.text) and r.lang == "en" for r in got), name
        sizes.append((len(want), sum(len(t) for _, t, _ in want)))
    # each stage had something to do
    assert len(rows) > sizes[0][0] > sizes[1][0] == sizes[2][0] and sizes[1][1] > sizes[2][1] and len({r[0] for r in want}) < len(want)
    library = Tokenizer.from_file(tokenizer_path())
    ids = sorted((k, library.encode(t, add_special_tokens=False).ids) for k, t, _ in want)
    assert sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids").collect()) == ids


def test_stages_in_order_and_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, small)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        kept = out
    assert 0 < kept.count() <= 3 * docs.count()


def test_stages_survive_odd_rows_and_names(spark, small):
    rows = [(1, "some text that is here to stay", None, 1, 2, 3, 4), (1, "some text that is here to stay", "a", 1, 2, 3, 4), (None, None, "a", 1, 2, 3, 4), (2, "", "b", 1, 2, 3, 4), (3, "y " * 5000, "b", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, rid int, n_copies int, keep int, `kept.a` int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, small)
            assert out.count() <= 3 * frame.count(), name
            assert name == "BPE encoding" or out.columns == docs.columns
            assert name == "BPE encoding" or {r.keep for r in out.collect()} <= {3, None}


def test_run_gives_ids(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert out.where("size(ids) <> n_tokens").count() == 0


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 11))
