"""Queries without SQL twins, over their whole lens, against plain versions."""

import collections
import datetime as dt
import difflib
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from docketlake.operators import graph as G
from docketlake.operators import records as R
from docketlake.operators import text as T
from docketlake.plans import catalog
from docketlake.plans.lenses import lens

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def rows(spark, name):
    return lens(spark, SF, name).collect()


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_events_are_kept_in_order(spark):
    texts = {r.doc_id: r.text for r in rows(spark, "chron")}
    dates = {r.doc_id: r.day for r in run(spark, "chr1_dates")}
    by = collections.defaultdict(list)
    for i in sorted(texts):
        by[dates[i]].append((i, texts[i]))
    want = set()
    for day, events in by.items():
        kept = []
        for i, t in events:
            if not any(ratio(k, t) >= 0.75 for k in kept):
                kept.append(t)
                want.add((i, day))
    assert {(r.event_id, r.day) for r in run(spark, "chr4_dedup_events")} == want and len(want) < len(texts)


def test_conflicts_are_of_classes(spark):
    events = [(r.change_id, r.doc_id, dt.date(2024, 1, 1) + dt.timedelta(r.doc_id % 5), r.old_text) for r in rows(spark, "clause")]
    classes = collections.defaultdict(list)
    for e in events:
        classes[e[3], e[2]].append(e)
    reps = [(t, d, min(e[0] for e in es), {e[1] for e in es}) for (t, d), es in classes.items()]
    want = set()
    like = {(a, b): a == b or ratio(*sorted((a, b))) >= 0.6 for a in {x[0] for x in reps} for b in {x[0] for x in reps}}
    for i, a in enumerate(reps):
        for b in reps[:i]:
            if a[1] != b[1] and like[a[0], b[0]] and len(a[3] | b[3]) > 1:
                want.add((min(a[2], b[2]), max(a[2], b[2])))
    assert {tuple(r) for r in run(spark, "chr6_conflicts")} == want and want
    df = spark.createDataFrame(events, "event_id long, doc_id long, day date, text string")
    assert {(r.event_id, r["class"]) for r in T.conflict_classes(df).collect()} == {(e[0], min(x[0] for x in classes[e[3], e[2]])) for e in events}


def test_first_statements(spark):
    by = collections.defaultdict(list)
    want = set()
    for r in sorted(rows(spark, "statement"), key=lambda r: r.event_id):
        if not any(difflib.SequenceMatcher(None, k, r.text.lower()).ratio() >= 0.75 for k in by[r.day]):
            by[r.day].append(r.text.lower())
            want.add((r.event_id, r.day, r.text))
    assert {tuple(r) for r in run(spark, "chr4_first_statements")} == want and len(want) < spark.read.parquet(f"{SF}/documents.parquet").count() * 5


def test_statement_conflicts(spark):
    classes = collections.defaultdict(list)
    for r in rows(spark, "statement"):
        classes[r.text, r.day].append((r.event_id, r.doc_id))
    by_text = collections.defaultdict(list)
    for (t, d), es in classes.items():
        by_text[t].append((d, min(e for e, _ in es), {x for _, x in es}))
    texts, want = sorted(by_text), set()
    m = difflib.SequenceMatcher(None)
    for j, b in enumerate(texts):
        m.set_seq2(b.lower())
        for a in texts[: j + 1]:
            m.set_seq1(a.lower())
            if a == b or m.real_quick_ratio() >= 0.6 and m.quick_ratio() >= 0.6 and m.ratio() >= 0.6:
                want |= {(min(x[1], y[1]), max(x[1], y[1])) for x in by_text[a] for y in by_text[b] if x[0] != y[0] and len(x[2] | y[2]) > 1}
    assert {tuple(r) for r in run(spark, "chr6_statement_conflicts")} == want and len(want) > 100


def plain_chunks(text, most, overlap):
    out, held = [], []
    new = 0
    for s in [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]:
        if new and sum(len(x) // 4 for x in held) + len(s) // 4 > most:
            out.append(" ".join(held))
            while sum(len(x) // 4 for x in held) > overlap:
                held.pop(0)
            new = 0
        held.append(s)
        new += 1
    return out + [" ".join(held)] * (new > 0)


def test_token_chunks(spark):
    texts = collections.defaultdict(list)
    for r in sorted(rows(spark, "segment"), key=lambda r: (r.rec_id, r.id)):
        texts[r.rec_id].append(r.text)
    want = {(d, i): c for d, ts in texts.items() for i, c in enumerate(plain_chunks(" ".join(ts), 200, 40))}
    got = run(spark, "chk3_chk5_token_chunks")
    assert {(r.doc_id, r.chunk): r.text for r in got} == want and all(r.tokens == len(r.text) // 4 for r in got)


def test_structure_chunks(spark):
    sections = collections.defaultdict(list)
    for r in sorted(T.running_section(lens(spark, SF, "block")).collect(), key=lambda r: (r.doc_id, r.pos)):
        sections[r.doc_id].append((r.section or "Preamble", r.text))
    want = {}
    size = lambda group: sum(len(t) // 4 for _, t in group)
    for d, parts in sections.items():
        groups = []  # lists of sections that stay together; one above 24 tokens takes a small one before it along
        for h, t in parts:
            last = groups[-1] if groups and size(groups[-1][-1:]) <= 24 else None
            if len(t) // 4 > 24:
                groups = groups[:-1] + [[*last, (h, t)]] if last and size(last) < 8 else [*groups, [(h, t)]]
            elif last and (size(last) < 8 or size(last) + len(t) // 4 < 0.8 * 24):
                last.append((h, t))
            else:
                groups.append([(h, t)])
        chunks = []
        for g in groups:
            text = "\n\n".join(t for _, t in g)
            if len(g[-1][1]) // 4 > 24:
                cut = plain_chunks(text, 24, 4)
                chunks += [(g[-1][0] + (f" (part {k})" if len(cut) > 1 else ""), c, len(c) // 4) for k, c in enumerate(cut, 1)]
                continue
            head = g[0][0]
            for k in range(1, len(g)):
                if (head, g[k][0]) != ("Preamble", "Preamble"):
                    head = g[k][0] if size(g[: k + 1]) < 8 else f"{head} / {g[k][0]}"
            chunks.append((head, text, size(g)))
        want |= {(d, i): c for i, c in enumerate(chunks)}
    got = {(r.doc_id, r.chunk): (r.heading, r.text, r.tokens) for r in run(spark, "chk4_structure_chunks")}
    assert got == want


def test_structure_chunks_of_large_sections(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(12))
    rows = [(1, 0, None, "tiny"), (1, 1, "A", long), (1, 2, "B", "b" * 60), (1, 3, "C", long), (1, 4, "D", "d" * 20), (2, 0, "X", "x" * 400), (3, 0, None, "p"), (3, 1, None, "q"), (3, 2, "E", "e" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, heading string, text string")
    got = collections.defaultdict(list)
    for r in T.structure_chunks(df, 40, 10, 8).orderBy("doc_id", "chunk").collect():
        got[r.doc_id].append((r.heading, r.text, r.tokens))
    parts = lambda t: plain_chunks(t, 40, 10)
    named = lambda h, t: [(f"{h} (part {k})", c, len(c) // 4) for k, c in enumerate(parts(t), 1)]
    assert got[1] == [*named("A", f"tiny\n\n{long}"), ("B", "b" * 60, 15), *named("C", long), ("D", "d" * 20, 5)]
    assert got[2] == [("X", "x" * 400, 100)] and got[3] == [("Preamble / E", "p\n\nq\n\n" + "e" * 40, 10)]


def pieces_of(text, most):
    """By looking at each possible end from the back."""
    out = []
    while len(text) > most:
        for mark in ("\n\n", ". "):
            ends = [k for k in range(1, most - 1) if text[k : k + 2] == mark]
            if ends:
                break
        cut = ends[-1] + 2 if ends else most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def test_paragraph_chunks(spark):
    texts = ["", "a" * 12, "ab\n\ncd\n\nefghij", "\n\nabcdefgh", None, "a. bcdefgh. i", "ab. c\n\nd. efghij", ". abcdefg"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select("id", T.paragraph_chunks(F.col("t"), 5).alias("p"))
    assert {r.id: list(r.p) for r in df.collect()} == {i: [] if t is None else pieces_of(t, 5) for i, t in enumerate(texts)}
    got = collections.defaultdict(dict)
    for r in run(spark, "chk8_paragraph_chunks"):
        got[r.rec_id, r.id][r.piece] = r.text
    want = {(r.rec_id, r.id): pieces_of(r.text, 500) for r in rows(spark, "segment")}
    assert {k: [p[i] for i in sorted(p)] for k, p in got.items()} == want and any(len(p) > 1 for p in want.values())


def test_vocabulary_tokens(spark):
    import base64

    import tiktoken

    from docketlake.plans.q_text import VOCABULARY

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    e = tiktoken.Encoding("plain", pat_str=T.SPLIT, mergeable_ranks=ranks, special_tokens={})
    assert {(r.rec_id, r.id): r.tokens for r in run(spark, "chk6_vocabulary_tokens")} == {(r.rec_id, r.id): len(e.encode_ordinary(r.text)) for r in rows(spark, "segment")}
    df = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine ten."), (2, None)], "doc_id long, text string")
    assert [(r.chunk, r.text, r.tokens) for r in T.chunk_documents(df, 8, 4, VOCABULARY).orderBy("chunk").collect()] == [(0, "One two three. Four five six.", 8), (1, "Four five six. Seven eight nine ten.", 9)]


def test_diffs_replay(spark):
    docs = collections.defaultdict(lambda: ([], []))
    for r in rows(spark, "clause"):  # each side in order of its change and text
        docs[r.doc_id][0].append((r.change_id, r.old_text))
        docs[r.doc_id][1].append((r.change_id, r.new_text))
    by = collections.defaultdict(list)
    for r in run(spark, "dif1_dif2_paragraph_diff"):
        by[r.pair_id].append(r)
    for d, sides in docs.items():
        old, new = ([t for _, t in sorted(side)] for side in sides)
        gone, come = {r.old_index for r in by[d] if r.old_index is not None}, {r.new_index for r in by[d] if r.new_index is not None}
        assert [t for i, t in enumerate(old) if i not in gone] == [t for i, t in enumerate(new) if i not in come]
        for r in by[d]:
            assert r.type == ("modified" if None not in (r.old_index, r.new_index) else "deleted" if r.new_index is None else "added")
            assert (r.old_text, r.new_text) == (None if r.old_index is None else old[r.old_index], None if r.new_index is None else new[r.new_index])
            assert r.word_changes == (0 if r.type != "modified" else sum(o[0] != "equal" for o in difflib.SequenceMatcher(None, r.old_text.split(), r.new_text.split(), autojunk=False).get_opcodes()))


def test_similarity(spark):
    want = collections.Counter((r.change_id, round(ratio(r.old_text, r.new_text), 12)) for r in rows(spark, "clause"))
    assert collections.Counter((r.change_id, round(r.ratio, 12)) for r in run(spark, "dif5_similarity")) == want


def test_topics(spark):
    recs = collections.defaultdict(list)
    for r in sorted(rows(spark, "segment"), key=lambda r: (r.rec_id, r.id)):
        recs[r.rec_id].append(r)
    want = {}
    for rec, segs in recs.items():
        at, k = 0, 0
        while at < len(segs):
            start = segs[at].start_s if k == 0 else segs[at - 1].end_s
            end = next((j for j in range(at, len(segs)) if segs[j].end_s - start >= 60), len(segs) - 1)
            words = collections.Counter()
            for s in segs[at : end + 1]:
                words.update(w for w in re.findall(r"\b[a-zA-Z]{3,}\b", s.text.lower()) if w not in T.STOP_WORDS)
            want[rec, k] = (start, segs[end].end_s, end + 1 - at, sorted(words.values(), reverse=True)[:5], words)
            at, k = end + 1, k + 1
    got = run(spark, "win6_dep1_topics")
    assert {(r.rec_id, r.window) for r in got} == set(want)
    for r in got:
        start, end, n, best, words = want[r.rec_id, r.window]
        assert (r.start_s, r.end_s, r.segments) == (start, end, n)
        named = [w.lower() for w in r.topic.split(", ")]
        assert [words[w] for w in named] == best or (not best and r.topic == "General Discussion")


def test_pages(spark):
    at = collections.Counter()
    want = {}
    for r in sorted(rows(spark, "segment"), key=lambda r: (r.rec_id, r.id)):
        want[r.rec_id, r.id] = (at[r.rec_id] // 25 + 1, at[r.rec_id] % 25 + 1)
        at[r.rec_id] += max(1, len(textwrap.wrap(r.text, 65)))
    assert {(r.rec_id, r.id): (r.page, r.line) for r in run(spark, "win9_page_layout")} == want


def contacts(spark):
    n = collections.Counter()
    for r in rows(spark, "comm"):
        if "Unknown" not in (r.sender, r.recipient) and r.sender != r.recipient:
            n[min(r.sender, r.recipient), max(r.sender, r.recipient)] += 1
    adj = collections.defaultdict(dict)
    for (a, b), w in n.items():
        adj[a][b] = adj[b][a] = w
    return adj


def plain_rank(adj, alpha=0.85):
    rank = dict.fromkeys(adj, 1 / len(adj))
    for _ in range(100):
        rank = {v: (1 - alpha) / len(adj) + alpha * sum(rank[u] * w / sum(adj[u].values()) for u, w in adj[v].items()) for v in adj}
    return rank


def test_ranks_and_closeness(spark):
    adj = contacts(spark)
    want = plain_rank(adj)
    got = {r.node: r["rank"] for r in run(spark, "grf9_pagerank")}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-4 for v in want)
    close = {}
    for s in adj:
        dist, edge = {s: 0}, [s]
        while edge:
            edge = [w for v in edge for w in adj[v] if w not in dist and dist.setdefault(w, dist[v] + 1)]
        far, n = sum(dist.values()), len(adj)
        close[s] = (len(dist) - 1) / far * (len(dist) - 1) / (n - 1)
    paths = {r.node: r for r in run(spark, "grf7_grf8_path_centrality")}
    assert paths.keys() == close.keys() and all(abs(paths[v].closeness - close[v]) < 1e-9 for v in close)
    players = run(spark, "grf13_key_players")
    best = sorted(want, key=lambda v: (-round(got[v], 6), v))[:50]
    assert [r.node for r in players] == best
    assert all(r.contacts == len(adj[r.node]) and r.closeness == pytest.approx(close[r.node], abs=1e-4) and r.betweenness == pytest.approx(paths[r.node].betweenness, abs=1e-4) for r in players)


def gain_of_moves(adj, com):
    """The best that any node could add to the modularity by a move to a neighbour's community."""
    m2 = sum(sum(x.values()) for x in adj.values())
    k = {v: sum(x.values()) for v, x in adj.items()}
    tot = collections.Counter()
    for v in adj:
        tot[com[v]] += k[v]
    most = 0.0
    for v in adj:
        to = collections.Counter()
        for u, w in adj[v].items():
            to[com[u]] += w
        stay = to[com[v]] - (tot[com[v]] - k[v]) * k[v] / m2
        most = max([most, *[(to[c] - tot[c] * k[v] / m2 - stay) / m2 for c in to if c != com[v]]])
    return most


def test_communities_are_settled(spark):
    adj = contacts(spark)
    com = {r.node: r.community for r in run(spark, "grf10_communities")}
    assert com.keys() == adj.keys()
    members = collections.defaultdict(list)
    for v, c in com.items():
        members[c].append(v)
    assert all(c == min(vs, key=lambda v: (-sum(adj[v].values()), v)) for c, vs in members.items())  # named by the most active
    q = G.modularity(spark.createDataFrame([(a, b, w) for a in adj for b, w in adj[a].items() if a < b], "src string, dst string, weight long"), spark.createDataFrame(list(com.items()), "node string, community string")).first()[0]
    m2 = sum(sum(x.values()) for x in adj.values())
    plain = sum(sum(w for v in vs for u, w in adj[v].items() if com[u] == c) / m2 - (sum(sum(adj[v].values()) for v in vs) / m2) ** 2 for c, vs in members.items())
    assert abs(q - plain) < 1e-9 and q > 0
    # local moves of whole communities may leave a node a little off its best place, not more
    assert gain_of_moves(adj, com) < 0.005


def test_entity_communities(spark):
    edges = T.cooccurrence(T.mentions(lens(spark, SF, "mention"))).collect()
    adj = collections.defaultdict(dict)
    active = collections.Counter()
    for r in edges:
        adj[r.src][r.dst] = adj[r.dst][r.src] = 1
        active[r.src] += r.weight
        active[r.dst] += r.weight
    com = {r.node: r.community for r in run(spark, "grf12_entity_communities")}
    assert com.keys() == adj.keys() and gain_of_moves(adj, com) < 0.02
    for c in set(com.values()):
        assert c == min((v for v in com if com[v] == c), key=lambda v: (-active[v], v))


def test_matrix(spark):
    n = collections.Counter()
    for r in rows(spark, "comm"):
        n[r.sender, r.recipient] += 1
    long = {(r.sender, r.recipient): r.n for r in run(spark, "viz4_who_to_whom")}
    assert all(n[k] == v for k, v in long.items())
    wide = catalog.queries()["viz4_matrix"](spark, SF)
    names = [c for c in wide.columns if c != "sender"]
    got = {(r.sender, c): r[c] for r in wide.collect() for c in names if r[c]}
    assert got == long and len(names) <= 30


def test_calendar_events_without_a_date(spark):
    from docketlake.sources import sinks

    due = spark.createDataFrame([(1, 0, "a", None, "r")], "request_id long, step int, name string, due date, rule string")
    assert [tuple(r) for r in sinks.calendar_events(due).collect()] == [(1, None)]


def test_frames_of_three_passes(spark):
    videos = spark.createDataFrame([(1, 21_000)], "video_id long, length_ms long")
    scenes = spark.createDataFrame([(1, 1_000), (1, 4_000), (1, 20_500)], "video_id long, ts_ms long")
    got = collections.defaultdict(list)
    for r in R.plan_passes(videos, scenes).orderBy("ts_ms").collect():
        got[r["pass"]].append(r.ts_ms)
    dense = [x for x in [*range(0, 7_001, 500), *range(17_500, 21_001, 500)] if x % 5_000]
    assert got == {"coarse": [0, 5_000, 10_000, 15_000, 20_000], "dense": dense, "offset": [7_500, 12_500]}
    assert R.plan_passes(videos, scenes, most=3).count() == 3
