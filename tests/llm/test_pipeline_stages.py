"""Each pipeline stage against a brute-force version, over tables with every awkward row."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from test_exact import ALNUM, lower, repeats_of
from test_language_model import limits, plain, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_lines string, _gone long, g long, id string"


def _row(i, t, lang="en"):
    return i, t, lang, "src", len(t) if t is not None else None, True, "x", 5, 6, "y"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rng = random.Random(21)
    common = [f"w{i}" for i in range(80)]
    good = [" ".join(rng.choices(common, [1 / (k + 1) for k in range(80)], k=rng.randint(30, 60))) for _ in range(240)]
    passage = "\n".join(" ".join(rng.choices(common, k=20)) for _ in range(3))
    rows = [_row(i, t, "en" if i % 2 else None) for i, t in enumerate(good)]
    rows += [_row(300 + i, " ".join(f"j{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(5)]
    rows += [_row(400 + i, f"{good[i]}\n{passage}\n{good[i + 9]}") for i in range(4)] + [_row(410 + i, passage) for i in range(3)]
    near = good[0].split()
    rows += [_row(500, " ".join(near[:-1] + ["w79"])), _row(501, good[1]), _row(502, "  ".join(good[1].split()).upper())]
    item = " ".join(rng.choices(common, k=14))
    rows += [_row(600, good[2] + " " + item + " " + good[3]), _row(601, item), _row(602, item[: len(item) // 3])]
    rows += [_row(700, None), _row(701, ""), _row(702, " \n\t"), _row(703, " ".join(rng.choices(common, k=9000))), _row(704, "x")]
    rows += [_row(None, good[4]), _row(None, good[4]), _row(None, None), _row(5, good[5]), _row(5, good[5]), _row(600, rows[-1][1])]
    folder = tmp_path_factory.mktemp("awkward")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 240) if i % 6], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "w1 w2 qq")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.read.parquet(f"{awkward[0]}/documents.parquet")


def _rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_quality(spark, awkward, docs):
    from graphloom.llm.quality_lm import LEAST, QUANTILE
    from graphloom.llm.trusted import held_out

    folder, rows, _ = awkward
    texts, lang = collections.defaultdict(list), {}
    for i, t, x, *_ in rows:
        if i is not None:
            texts[i].append(t or "")
            lang[i] = max((y for y in (x, lang.get(i)) if y is not None), default=None)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect()}
    held = {r["doc_id"] for r in labels.where(held_out("doc_id")).collect()}
    score = plain([t for i in sorted(good - held) for t in texts[i]])
    n = {i: sum(len(t.split()) for t in ts) for i, ts in texts.items()}
    loss = {i: -sum(map(score, ts)) / (n[i] + 1) for i, ts in texts.items() if n[i]}
    again = {i: 1 - sum(round((1 - repeats(t)) * (len(t.split()) + 1)) for t in ts) / (n[i] + 1) for i, ts in texts.items() if n[i]}
    most, worst = limits(loss, held, n, lang, QUANTILE, LEAST), limits(again, good, n, lang, QUANTILE, LEAST, False)
    got = stage("quality_classifier")(spark, docs, folder)
    assert got.columns == docs.columns
    kept, before = _rows(got), _rows(docs)
    sure = 0
    for row, times in before.items():
        i = row[0]
        if i is None:
            assert kept[row] == times
        elif not n[i]:
            assert not kept[row]
        elif abs(loss[i] * 1024 - most[i]) > 2:
            sure += 1
            assert kept[row] == (times if loss[i] * 1024 <= most[i] and round(again[i] * 1024) <= worst[i] else 0), row
    assert sure > 200 and sum(kept.values()) < sum(before.values()) - 5 and set(kept) <= set(before)


def test_lines(spark, awkward, docs):
    folder, rows, _ = awkward
    # rows of one key and different texts are documents of their own here: keep to those whose key says one text
    one = docs.where("doc_id is null or doc_id <> 600")
    source = {i: t for i, t, *_ in rows if i is not None and i != 600}
    gone = repeats_of(source, 50)
    assert gone
    want = collections.Counter()
    for row, times in _rows(one).items():
        i, t = row[:2]
        left = row
        if i is not None and gone.get(i):
            lines = [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
            left = (i, "\n".join(lines), *row[2:4], len("\n".join(lines)), *row[5:]) if lines else None
        if left:
            want[left] += times
    assert _rows(stage("line_dedup")(spark, one, folder)) == want


def test_near(spark, awkward, docs):
    folder, rows, _ = awkward
    one = docs.where("doc_id is null or doc_id <> 600")
    sets = {}
    for i, t, *_ in rows:
        if i is not None and i != 600:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[least[i]] == least[i] for i in sets):
            break
    assert sum(least[i] != i for i in sets) >= 4
    want = collections.Counter({row: times if row[0] is None else 1 for row, times in _rows(one).items() if row[0] is None or least[row[0]] == row[0]})
    assert _rows(stage("near_dedup")(spark, one, folder)) == want


def test_decontamination(spark, awkward, docs):
    folder, rows, item = awkward
    windows = [item.split()[k : k + 10] for k in range(5)] + [["w1", "w2", "qq"]]
    want = collections.Counter()
    for row, times in _rows(docs).items():
        t = row[1]
        found = list(re.finditer(ALNUM.pattern, lower(t)))
        w = [m[0] for m in found]
        hit = {k + j for p in windows for k in range(len(w)) if w[k : k + len(p)] == p for j in range(len(p))}
        if hit and len(hit) == len(w):
            continue
        if hit:
            out, at = "", 0
            for k in sorted(hit):
                if k - 1 not in hit:
                    out += t[at : found[k].start()]
                if k + 1 not in hit:
                    out, at = out + " ", found[k].end()
            t = out + t[at:]
        want[(row[0], t, *row[2:4], row[4] if t is None else len(t), *row[5:])] += times
    got = _rows(stage("decontamination")(spark, docs, folder))
    assert got == want and got != _rows(docs)


def test_packing(spark, awkward, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows, _ = awkward
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stage("packing")(spark, docs, folder).collect()
    fill, parts = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for r in pieces:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for held in fill.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    whole = collections.defaultdict(list)
    for i, t, *_ in rows:
        whole[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert set(whole) == set(parts)
    for i, texts in whole.items():
        assert sum(length * k for (_, length, _, _), k in parts[i].items()) == sum(map(len, texts))
        for (start, length, crc, tokens), _ in parts[i].items():
            made = [x for x in texts if len(x) == tokens]
            assert any(zlib.crc32(b"".join(t.to_bytes(4, "little") for t in x[start : start + length])) == crc for x in made)


def test_empty_tables(spark, awkward, docs):
    import corpus_pipeline

    folder, none = awkward[0], docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, folder).count() == 0, name
        if name != "packing":
            assert f(spark, none, folder).columns == docs.columns


def test_whole_pipeline(spark, awkward, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, awkward[0])
    assert out.count() > 100 and out.where(F.col("doc_id").isin(300, 301, 700, 701)).count() == 0
