"""The manifest against a tree built node by node on the driver."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))


def climb(nodes, i):
    """(root, siblings level by level) of node i."""
    proof = []
    while len(nodes) > 1:
        first = i // 8 * 8
        proof.append((i - first, nodes[first:i] + nodes[i + 1 : first + 8]))
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        i //= 8
    return nodes[0], proof


def brute(docs):
    langs = defaultdict(list)
    for d in docs:
        langs[d["lang"]].append(d)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in names:
        rows = sorted(langs[lang], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        trees[lang] = rows, [leaf(d, d["text"]) for d in rows]
    subroots = [climb(trees[x][1], 0)[0] for x in names]
    out = []
    for j, lang in enumerate(names):
        rows, leaves = trees[lang]
        for i, d in enumerate(rows):
            sub, low = climb(leaves, i)
            root, high = climb(subroots, j)
            text = d["text"]
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(d, text)
            for place, rest in low + high:
                node = H(*rest[:place], node, *rest[place:])
            out.append((d["doc_id"], leaves[i], sub, root, H(*(x for _, rest in low + high for x in rest)), node, node == root))
    return sorted(out, key=str)


def run(df, **more):
    return merkle.manifest(df, claimed=merkle.tampered_leaf(), **more)


def as_tuples(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = as_tuples(QUERIES["op13_merkle_manifest"](spark, sf))
    assert got == brute(docs)
    assert 0 < sum(g[-1] for g in got) < len(got)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_rounds_ragged_ends_and_many_groups(rows, monkeypatch, levels):
    """Blocks of 8 rows make many rounds; groups of 1 to 700 rows, 70 of them."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    sizes = [700, 65, 64, 9, 8, 1, 513] + [rng.randint(1, 20) for _ in range(63)]
    data, at = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            data.append((at, rng.choice(["Aa", "é", "", None]), [None, ""][g] if g < 2 else f"l{g}ü", "s", at))
            at += 1
    rng.shuffle(data)
    df = rows(data, SCHEMA, 5)
    assert as_tuples(run(df)) == brute([r.asDict() for r in df.collect()])


def test_odd_rows(rows):
    big = 2**53 + 1
    data = [(None, None, None, None, None)] * 3 + [(big, "A" * 200_000, "en", "s", 1)] * 2
    data += [(big, "B", "en", "s", 1), (big, None, "en", "s", 1), (-1, "\n", "", "", 0)]
    df = rows([(*d, "clash") for d in data], SCHEMA + ", LEAF string")
    assert as_tuples(run(df)) == brute([r.asDict() for r in df.collect()])
    one = rows([(1, "x", "en", "s", 1)], SCHEMA)
    got = merkle.manifest(one).first()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.verified
    empty = merkle.manifest(rows([], SCHEMA))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_string_keys_and_stored_proofs(rows):
    df = rows([(f"k{i}", f"T{i}", f"l{i % 3}") for i in range(300)], "name string, text string, part string", 3)
    got = merkle.manifest(df, "name", "part", ("name", "text"), with_proof=True)
    folded = got.select("root", "verified", merkle.fold(F.col("leaf"), F.col("proof")).alias("again"), merkle.fold(F.sha2("leaf", 256), F.col("proof")).alias("bad"))
    rows_ = folded.collect()
    assert len(rows_) == 300 and all(r.verified and r.again == r.root != r.bad for r in rows_)
    assert len({r.root for r in rows_}) == 1
