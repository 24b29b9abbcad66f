"""run() against a plain Python version: the first three stages row for row, mixing by its totals and word runs, ids by the library."""

import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("corpus_pipeline")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"


def repeated(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


def plain_kept(docs):
    """Documents after quality rules (too few labels here for any but the base rule), line dedup and near-dedup."""
    kept = {}
    for i, (text, source) in docs.items():
        words = WORDS.findall(text or "")
        if len(words) >= 20 and 100 * repeated(words) <= 30 * len(words):
            kept[i] = (text, source)
    sites, first = defaultdict(set), {}
    for i in sorted(kept):
        for p, line in enumerate(kept[i][0].split("\n")):
            if len(WORDS.findall(line)) >= 3:
                sites[line.strip(STRIP)].add(kept[i][1])
                first.setdefault(line.strip(STRIP), (i, p))
    cleaned = {}
    for i, (text, source) in kept.items():
        lines = [x for p, x in enumerate(text.split("\n")) if len(sites.get(x.strip(STRIP), ())) < 8 or first[x.strip(STRIP)] == (i, p)]
        if len(lines) == len(text.split("\n")) or WORDS.search("\n".join(lines)):
            cleaned[i] = ("\n".join(lines), source)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, (text, _) in cleaned.items():
        w = WORDS.findall(text.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: row for i, row in cleaned.items() if find(i) == i}


def targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, capped = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in capped)
        target = {n: 2 * sizes[n] if n in capped else rest * weight[n] / sum(weight[m] for m in names if m not in capped) for n in names}
        over = {n for n in names if n not in capped and target[n] > 2 * sizes[n]}
        if not over:
            return target
        capped |= over


def test_run_gives_the_rows_of_plain_python(spark, tmp_path):
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(100_000, None, "en", "src1", 0), (100_001, "", "en", None, 0), (100_002, " ".join(f"odd{i}" for i in range(40)) + "\n|#", None, None, 5)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(3)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    expected = plain_kept(rows)

    stage_docs = docs
    for k, (_, stage) in enumerate(cp.STAGES[:3]):
        stage(spark, stage_docs, sf).write.parquet(f"{sf}/stage{k}")
        stage_docs = spark.read.parquet(f"{sf}/stage{k}")
    assert {r.doc_id: (r.text, r.source) for r in stage_docs.collect()} == expected

    sizes, taken, size = Counter(), Counter(), {i: len(WORDS.findall(t)) for i, (t, _) in expected.items()}
    for i, (_, s) in expected.items():
        sizes[s] += size[i]
    of_doc, library = Counter(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in cp.run(spark, sf).collect():
        own, words = WORDS.findall(expected[r.doc_id][0]), WORDS.findall(r.text)
        # what is drawn are words of the document in their order
        at = 0
        for w in words:
            at = own.index(w, at) + 1
        assert r.source == expected[r.doc_id][1] and (len(words) < len(own) or r.text == expected[r.doc_id][0])
        taken[r.source] += len(words)
        of_doc[r.doc_id] += len(words)
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text and r.n_tokens == len(r.ids)
    assert all(n <= 2 * size[i] for i, n in of_doc.items())
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
