"""Shared lines of hosts, with the limits that the queries use."""

from braggflow.llm import quality


def test_shared_lines_go_at_the_production_limits(spark):
    rows, shared = [], "a footer that pages of this host share"
    for host, docs, having in (("hot", 400, 35), ("below", 400, 30), ("small", 12, 12), ("two", 2, 2)):
        for i in range(docs):
            own = " ".join(f"{host}{i}x{j}" for j in range(12))
            rows.append((len(rows), f"{own}\n{shared}" if i < having else own, host))
    rows += [(9000 + i, f"{shared}\n" * (4 + i) + "left over", "hot") for i in range(3)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    host = {i: h for i, _, h in rows}
    gone = {h: sum(bool(r.removed) for r in got if host[r.doc_id] == h) for h in ("hot", "below", "small", "two")}
    assert gone == {"hot": 38, "below": 0, "small": 12, "two": 0}
    assert not any(r.kept for r in got if r.doc_id >= 9000)
