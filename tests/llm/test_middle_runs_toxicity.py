import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.test_operators import docs, hard, none, rows_of  # noqa: F401

from trialforge.llm import middle, runs, toxicity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fill_in_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return len(units), "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


CONTROL = ["<P>", "a<S>b c", "x <M", "<", "<P", "> <S", "P> word\nmore<M words", "\x01\x02 a\x03b", "é́日本 abc\r\n\t ok", " ", "\U0001f600x"]


def test_fill_in_middle_matches_plain_version(spark, docs, hard, none):
    odd = spark.createDataFrame([(i * 7 + k, t) for i in range(20) for k, t in enumerate(CONTROL)], "doc_id long, text string")
    for df in (docs, hard, odd):
        want = sorted((str(r.doc_id), *map(str, plain_fill_in_middle(r.doc_id, r.text))) for r in df.select("doc_id", "text").collect())
        got = middle.fill_in_middle(df)
        assert got.columns == middle.NAMES
        assert sorted(tuple(map(str, r)) for r in got.collect()) == want
        back = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
        found = middle.digests(got).collect()
        assert sorted((str(r.doc_id), r.restored_sha256) for r in found) == sorted((str(r.doc_id), sha(r.t)) for r in back)
        assert sorted((str(r.doc_id), r.output_sha256) for r in found) == sorted((x[0], sha(x[-1])) for x in want)
    forms = {r.form for r in middle.fill_in_middle(odd).collect()}
    assert forms == {"plain", "psm", "spm"}
    assert middle.digests(middle.fill_in_middle(none)).count() == 0


def test_fill_in_middle_in_parts(spark, docs, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(CONTROL) + 1)), "text": [*CONTROL, None], **{f"h{i}": pa.array(range(i * 1000, i * 1000 + len(CONTROL) + 1), pa.int64()) for i in range(1, 5)}})
    whole = middle.rearrange(batch, 90, 20).to_pylist()
    assert whole == [r for k in range(batch.num_rows) for r in middle.rearrange(batch.slice(k, 1), 90, 20).to_pylist()]


def test_separator_is_in_no_text():
    texts = pa.array(["".join(map(chr, range(1, 40))), "\x28", None])
    assert middle.separator(texts.fill_null("")) == "\x29"
    ascii_text = "".join(map(chr, range(1, 92)))
    assert middle.separator(pa.array([ascii_text])) == "]" and "".join(middle.units_of(pa.array([ascii_text])).to_pylist()[0]) == ascii_text
    assert middle.units_of(pa.array(["ab1\x01", ""])).to_pylist() == [["ab", "1", "\x01"], [""]]


def plain_runs(w, repeats=4, least=6):
    """All maximal runs by trying every period at every place; (start, end, period)."""
    found = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p) and j > i:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def random_texts(rng):
    texts = []
    for _ in range(int(rng.integers(1, 8))):
        n = int(rng.integers(0, 200))
        x = rng.integers(0, int(rng.integers(1, 4)), n).tolist()
        if n and rng.random() < 0.5:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, max(2, n // 4)))
            x = x[:a] + (x[a : a + p] * n)[: n - a]
            x[int(rng.integers(0, n))] = int(rng.integers(0, 4))
        texts.append([b"%d" % v for v in x])
    return texts


def test_runs_match_all_periods_at_all_places(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(150):
        monkeypatch.setattr(runs, "GRID_POINTS", int(rng.choice([30, 2_000_000])))
        texts, repeats, least = random_texts(rng), int(rng.integers(3, 6)), int(rng.integers(3, 9))
        words, starts, sizes = runs.symbols_of(texts)
        want = sorted(((a + int(o), b + int(o), p) for t, o in zip(texts, starts, strict=True) for a, b, p in plain_runs(t, repeats, least)), key=lambda r: (r[0], r[2]))
        assert [tuple(map(int, r)) for r in runs.runs_of(words, starts, sizes, repeats, least)] == want


def test_grammar_spells_the_text_and_its_extensions_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(60):
        words, _, _ = runs.symbols_of([*random_texts(rng), [b"1"] * 50])
        g = runs.Grammar.of(words)
        assert len(np.unique(g.symbols[-1])) == len(g.symbols[-1])
        for step, low, high in zip(g.steps, g.symbols[:-1], g.symbols[1:], strict=True):
            spelt = {}
            for j, name in enumerate(high.tolist()):  # one name, one spelling
                assert spelt.setdefault(name, tuple(low[step.first[j] : step.first[j + 1]])) == tuple(low[step.first[j] : step.first[j + 1]])
            assert len(set(spelt.values())) == len(spelt)
        i, j = rng.integers(1, len(words) - 1, (2, 40))
        i, j = i[i != j], j[i != j]
        for back, d in ((False, 1), (True, -1)):
            plain = []
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                k = 0
                while 0 <= a + d * k and 0 <= b + d * k and max(a, b) + d * k < len(words) and words[a + d * k] == words[b + d * k]:
                    k += 1
                plain.append(k)
            assert g.common(i, j, back).tolist() == plain


def plain_collapse(words, found):
    gone = {i for a, b, p in found for i in range(a + p, b)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def plain_digests(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(((a - b, a, p) for a, b, p in found), default=None)
    row = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in found)
    return (doc_id, len(found), *row, sha(lines), hashlib.sha256(plain_collapse(words, found)).hexdigest())


def test_periodic_runs_match_plain_version(spark, docs, hard, none, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 3000)
    some = docs.select("doc_id", "text")
    made = spark.createDataFrame([(1000 + i, " ".join(f"w{j % (3 + i)}" for j in range(40 * i)) + " end " + "go " * i) for i in range(30)] + [(None, "la " * 50), (5, None)], some.schema)
    for df in (some, made):
        got = runs.digests(runs.periodic_runs(df, prepare=runs.repeated_tail))
        want = [plain_digests(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
        assert any(w[1] for w in want) and any(not w[1] for w in want)
    found = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(hard).collect()}
    assert found[0, 0].runs == [] and found[0, 0].collapsed == "" and found[2, 0].collapsed == ""
    assert runs.periodic_runs(hard).count() == hard.count() and runs.digests(runs.periodic_runs(none)).count() == 0


def test_runs_of_one_word_and_nested_runs():
    words = [b"a"] * 9 + [b"b"] + [b"a"] * 9 + [b"b"]
    texts = [words * 5, [b"x"] * 100_000]
    w, starts, sizes = runs.symbols_of(texts)
    found = [tuple(map(int, r)) for r in runs.runs_of(w, starts, sizes)]
    assert found[-1] == (int(starts[1]), int(starts[1]) + 100_000, 1)
    assert [(a - 1, b - 1, p) for a, b, p in found[:-1]] == plain_runs(texts[0])
    assert (0, 100, 10) in plain_runs(texts[0]) and runs.collapse(texts[0], np.array(plain_runs(texts[0]))) == plain_collapse(texts[0], plain_runs(texts[0])) == b"a b"


def rank_area(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        ranks[score == s] = ranks[score == s].mean()
    p = label.sum()
    return (ranks[label == 1].sum() - p * (p + 1) / 2) / (p * (len(score) - p))


def test_toxicity_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = toxicity.score(d, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert rank_area(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.93
    assert (held["predicted"] == held["toxic"]).mean() > held["toxic"].rsub(1).mean() + 0.06
    assert held["score"].between(0, 1).all() and ((held["score"] >= 0.5) == (held["predicted"] == 1)).all()


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 47, 48, 49, 1000):
        b = toxicity.plain("".join(rng.choice(list("abc  é\n"), n)))
        w = toxicity.windows(b)
        assert w[0][0] == 0 and w[-1][1] == len(b) and all(0 <= a - c <= 1 or a == c - 1 for (_, c), (a, _) in zip(w, w[1:], strict=False))
        assert all(e - a + len(toxicity.TAIL) < 64 for a, e in w)


def test_gains_are_differences_of_compressed_lengths():
    import zstandard as z

    bad, good = b" vile rotten words ", b" the and of in with from "
    c = toxicity.Compressors(good, bad)
    pieces = [b" rotten ", b" the and of ", b" other thing", b"", b" vile rotten words and the and of "]
    setting = z.ZstdCompressionParameters.from_level(3, min_match=6, strategy=z.STRATEGY_GREEDY, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_dict_id=False)
    one = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(x + toxicity.PREAMBLE, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=setting) for x in (good, bad + good)]
    assert c.gains(pieces).tolist() == [len(one[0].compress(toxicity.PREAMBLE + p + toxicity.TAIL)) - len(one[1].compress(toxicity.PREAMBLE + p + toxicity.TAIL)) for p in pieces]
    assert c.gains(pieces)[0] > 0 and c.gains(pieces)[1] == 0
    texts = ["rotten " * 30, None, "plain talk " * 900]
    assert np.allclose(c.features(texts), np.concatenate([c.features([t]) for t in texts])) and np.allclose(c.features(texts), c.features(texts, most=100))


def test_toxicity_of_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i in range(11)] + [(None, 1, 1, "x"), (4, 0, None, None), (3, None, 1, None)], "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(hard, labels)
    rows = got.collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(none, labels).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert len({r.score for r in toxicity.score(hard, few).collect()}) == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_telling_pieces_are_those_of_toxic_texts_alone(seed):
    rng = np.random.default_rng(seed)
    common = ["the", "and", "house", "garden", "summer", "water"]
    text = lambda extra: toxicity.plain(" ".join([*rng.choice(common, 40), *extra]))
    toxic, ordinary = [text(["dreadful"]) for _ in range(60)], [text([]) for _ in range(300)]
    pieces = toxicity.telling_pieces(toxic, ordinary)
    assert pieces and all(p.strip() in b" dreadful " for p in pieces)
