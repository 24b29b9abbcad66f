"""Proposals against a fold that applies one change after the other."""

import hashlib
import random

from tidewatch.operators import patches

FILES = "workspace long, path string, content string"
CHANGES = "workspace long, patch_id long, nr long, path string, action string, expected_sha256 string, content string"
LIMITS = patches.Limits(changes=6, file_bytes=20, patch_bytes=45, files=6, total_bytes=60)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rule(now: dict, seen: set, spent: int, path, action, want, content):
    """The rule that a change breaks in the state that the ones before it left."""
    if not path or path.startswith("../"):
        return "path"
    if path in seen:
        return "path again"
    if action not in ("create", "update", "delete"):
        return "action"
    if want is not None and len(want) != 64:
        return "hash form"
    if action == "create":
        if path in now:
            return "exists"
        if want is not None:
            return "hash of nothing"
        if any(path.startswith(p + "/") for p in now):
            return "below a file"
        if any(p.startswith(path + "/") for p in now):
            return "is a directory"
    elif path not in now:
        return "missing"
    elif want is not None and sha(now[path]) != want:
        return "hash differs"
    if action == "delete":
        return None if content is None else "content of a deletion"
    if content is None:
        return "no content"
    if len(content) > LIMITS.file_bytes:
        return "file too large"
    if action == "update" and content == now[path]:
        return "no change"
    return "patch too large" if spent + len(content) > LIMITS.patch_bytes else None


def expected(files, rows):
    verdicts, ends = {}, {}
    for key in {(w, p) for w, p, *_ in rows}:
        now = {path: content or "" for w, path, content in files if w == key[0]}
        mine, seen, spent, end = sorted(r for r in rows if r[:2] == key), set(), 0, None
        for w, p, nr, path, action, want, content in mine:
            if end:
                verdicts[p, nr] = "not reached"
                continue
            broken = "too many changes" if len(mine) > LIMITS.changes else rule(now, seen, spent, path, action, want, content)
            verdicts[p, nr] = broken or "ok"
            if broken:
                end = (broken, nr)
                continue
            seen.add(path)
            spent += len(content or "")
            if action == "delete":
                del now[path]
            else:
                now[path] = content
        size = sum(map(len, now.values()))
        whole = "too many files" if len(now) > LIMITS.files else "file too large" if any(len(c) > LIMITS.file_bytes for c in now.values()) else "files too large" if size > LIMITS.total_bytes else "ok"
        verdict, nr = end or (whole, None)
        ends[key[1]] = (verdict, nr, len(now) if verdict == "ok" else None, size if verdict == "ok" else None)
    return verdicts, ends


def test_proposals_equal_a_fold_of_their_changes(spark):
    r = random.Random(11)
    names = ["a", "b", "a/x", "a/y", "a/x/k", "b/z", "c/d/e", "c", "c/d"]
    files, rows = [], []
    for w in range(60):
        held: list[str] = []
        for path in r.sample(names, 4):
            if not any(path.startswith(p + "/") or p.startswith(path + "/") for p in held):
                held.append(path)
                files.append((w, path, r.choice(["one", "two", "", None, "a text of thirty letters or so"] if w % 7 == 0 else ["one", "two", "", None])))
        texts = {p: c or "" for x, p, c in files if x == w}
        for p in range(4):
            for nr in range(r.choice([1, 2, 3, 4, 6, 7])):
                path = r.choice(names) if r.random() < 0.95 else r.choice(["../q", "", None])
                # mostly what can hold: deletions and updates of what is there, with the right hash
                action = r.choice(["delete", "update"]) if path in texts and r.random() < 0.9 else "create" if r.random() < 0.95 else r.choice(["rename", None, "update"])
                want = sha(texts.get(path, "")) if action in ("delete", "update") and r.random() < 0.6 else None
                want = want if r.random() < 0.85 else r.choice(["f00", sha("other")])
                content = None if action == "delete" and r.random() < 0.95 else r.choice(["one", "two", "", "seventeen letters", "a text of thirty letters or so", None] if r.random() < 0.35 else ["three", "four"])
                rows.append((w, w * 10 + p, nr, path, action, want, content))
    rows += [(100, 1000, nr, f"n{nr}", "create", None, "seventeen letters") for nr in range(4)]
    verdicts, ends = expected(files, [(*x[:3], x[3] or "", *x[4:]) for x in rows])
    held, asked = spark.createDataFrame([(*f, "odd") for f in files], FILES + ", verdict string"), spark.createDataFrame([(*x, 1) for x in rows], CHANGES + ", bytes int")
    assert {(x.patch_id, x.nr): x.verdict for x in patches.judged(held, asked, LIMITS).collect()} == verdicts
    assert {x.patch_id: (x.verdict, x.nr, x.files, x.bytes) for x in patches.proposals(held, asked, LIMITS).collect()} == ends
    # every rule is broken somewhere
    met = set(verdicts.values()) | {e[0] for e in ends.values()}
    assert met >= {"ok", "not reached", "path", "path again", "action", "hash form", "exists", "hash of nothing", "below a file", "is a directory", "missing", "hash differs", "no change", "too many changes", "file too large", "patch too large"}, met


def test_proposals_without_files_and_without_changes(spark):
    none, asked = spark.createDataFrame([], FILES), spark.createDataFrame([(1, 1, 0, "a/b", "create", None, "x")], CHANGES)
    assert [tuple(x) for x in patches.proposals(none, asked).collect()] == [(1, 1, "ok", "ok", None, 1, 1)]
    assert patches.proposals(none, spark.createDataFrame([], CHANGES)).count() == 0
