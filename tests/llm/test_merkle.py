import hashlib
import zlib

from conftest_llm import documents_of

from fairlead.llm import merkle, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, lower=False):
    out = ""
    for c in COLUMNS:
        v = r[c]
        if lower and c == "text" and v is not None:
            v = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(nodes, fan_out):
    """(root, segments of each node: [(left, right)] level by level)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // fan_out * fan_out
            ways[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fan_out])))
            at[k] = i // fan_out
        nodes = [h("".join(nodes[i:i + fan_out])) for i in range(0, len(nodes), fan_out)]
    return nodes[0], ways


def plain(rows, fan_out=16):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        low[s] = tree([leaf(r) for r in groups[s]], fan_out)
    if not order:
        return []
    root, above = tree([low[s][0] for s in order], fan_out)
    out = []
    for s, way in zip(order, above):
        for r, own in zip(groups[s], low[s][1]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            to = leaf(r, lower=hit)
            for a, b in own + way:
                to = h(a + to + b)
            out.append((r["doc_id"], leaf(r), low[s][0], root, h("".join(a + b for a, b in own + way)), to, to == root))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = told(queries.QUERIES["op12_merkle_manifest"](spark, sf))
    assert found == plain(rows)
    assert 0 < sum(not r[-1] for r in found) < len(found) / 2


def test_odd_rows(spark, odd, empty):
    assert told(merkle.manifest(odd)) == plain(odd.collect())
    assert told(merkle.manifest(empty)) == []
    one = documents_of(spark, [(3, "Alone", "en", "x")])
    assert told(merkle.manifest(one)) == plain(one.collect())


def test_deep_trees_and_a_hot_group(spark):
    rows = [(i * 7919 % 1000, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 37}") for i in range(700)]
    docs = documents_of(spark, rows)
    for fan_out in (2, 3):
        assert told(merkle.manifest(docs, fan_out=fan_out)) == plain(docs.collect(), fan_out)


def test_only_tampered_rows_fail(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert merkle.manifest(docs, every=2**33).where("NOT verified").count() <= 1  # crc32 0 only
