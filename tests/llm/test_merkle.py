"""Manifests against a plain Merkle tree, odd rows, and folds that start at the slot's own state."""

import hashlib

import pytest
from pyspark.sql import functions as F

from profilerec.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, at int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.LEAF_COLUMNS])


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def around(levels, i, fanout):
    out = []
    for row in levels[:-1]:
        first = i // fanout * fanout
        out.append((row[first:i], row[i + 1 : first + fanout]))
        i //= fanout
    return out


def plain(rows, fanout, change):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]], fanout) for s in names}
    top = tree([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = around(trees[s], i, fanout) + around(top, k, fanout)
            digest = leaf(change(r))
            for left, right in path:
                digest = h(*left, digest, *right)
            proof = h(*[x for left, right in path for x in left + right])
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(odd_rows):
    out = [(i, t, "en", None, len(t or "")) for i, t in odd_rows]
    out += [(i, f"Text {i} é", None if i % 7 == 0 else "de", "hot", i) for i in range(300)]
    out += [(1000 + i, "same", "en", f"s{i}", None) for i in range(20)]
    out += [(5, "Again", "en", "", 1), (5, "Again", "en", "", 1), (5, "other", "en", "", 1), (-3, "Minus", "en", "é", 2)]
    return [(*r, "clash", 4) for r in out]


@pytest.mark.parametrize("fanout, block_levels", [(16, 3), (16, 1), (3, 2)])
def test_manifest_equals_a_plain_tree(spark, rows, fanout, block_levels):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    columns = [F.lower("text") if c == "text" else F.col(c) for c in merkle.LEAF_COLUMNS]
    changed = F.when(F.col("doc_id") % 5 == 0, merkle.leaf_digest(*columns))
    manifest = merkle.Manifest(docs, changed=changed, options=merkle.ManifestOptions(fanout, block_levels))
    got = sorted([tuple(r)[:7] for r in manifest.verify().collect()], key=str)
    lower = lambda r: {**r, "text": r["text"].lower()} if r["doc_id"] is not None and r["doc_id"] % 5 == 0 and r["text"] else r
    want = plain([r.asDict() for r in docs.collect()], fanout, lower)
    assert got == want
    assert {r[6] for r in got} == {True, False}
    assert {r["subroot"] for r in manifest.group_roots().collect()} == {r[2] for r in want}


def test_one_row_and_no_rows(spark, rows):
    one = spark.createDataFrame(rows[:1], DOCS)
    (got,) = merkle.Manifest(one).verify().collect()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["verified"]
    assert got["proof_sha256"] == h() and got["slots"] == [] and got["n_siblings"] == 0
    empty = merkle.Manifest(one.limit(0))
    assert empty.root is None and empty.verify().collect() == [] and empty.group_roots().collect() == []


def test_a_fold_resumes_the_state_of_its_slot():
    children = [h(str(i)).encode() for i in range(7)]
    parent = merkle.Parent(children)
    for slot in range(7):
        changed = [*children[:slot], b"x" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"x" * 64) == merkle.Parent(changed).digest
        assert parent.before[slot].hexdigest() == hashlib.sha256(b"".join(children[:slot])).hexdigest()
    assert parent.fold(3, children[3]) == parent.digest
