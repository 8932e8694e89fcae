"""The tree of path templates against the same by plain Python on random trees, and its verdicts on planted branches."""

import math
import random
from collections import defaultdict

import pytest

from sealframe.llm import url_filter as U


def errors_apart(b1, n1, b2, n2):
    p1, p2 = (b1 + 1) / (n1 + 2), (b2 + 1) / (n2 + 2)
    return abs(p1 - p2) / math.sqrt(p1 * (1 - p1) / (n1 + 2) + p2 * (1 - p2) / (n2 + 2))


def merged(branches):
    """rate -> lowest rate of its group, of (labelled, bad) pairs."""
    sums = defaultdict(lambda: [0, 0])
    for n, b in branches:
        sums[b / n][0] += n
        sums[b / n][1] += b
    groups = [(r, n, b, [r]) for r, (n, b) in sums.items()]
    while True:
        groups.sort(key=lambda g: ((g[2] + 1) / (g[1] + 2), g[0]))
        z = [errors_apart(x[2], x[1], y[2], y[1]) for x, y in zip(groups, groups[1:], strict=False)] + [math.inf]
        joins = [i for i in range(len(groups) - 1) if z[i] < U.STANDARD_ERRORS and (i == 0 or z[i] < z[i - 1]) and z[i] <= z[i + 1]]
        if not joins:
            return {r: g[0] for g in groups for r in g[3]}
        for i in reversed(joins):
            x, y = groups[i : i + 2]
            groups[i : i + 2] = [(x[0], x[1] + y[1], x[2] + y[2], x[3] + y[3])]


def tree(counts):
    """(host, shape) -> (template, share) of (host, shape) -> (n, labelled, bad)."""
    todo = [(h, s.split("/") if s else [], c, "") for (h, s), c in counts.items()]
    final = {(h, "/".join(s)): "" for h, s, _, _ in todo if not s}
    todo, level = [x for x in todo if x[1]], 0
    while todo:
        nodes = defaultdict(list)
        for x in todo:
            nodes[x[0], x[3]].append(x)
        todo = []
        for (host, template), leaves in nodes.items():
            if len(leaves) == 1:
                ((_, segments, _, _),) = leaves
                final[host, "/".join(segments)] = "/".join([template, *segments[level:]])
                continue
            branch = defaultdict(lambda: [0, 0, 0])
            for _, segments, c, _ in leaves:
                for k in range(3):
                    branch[segments[level]][k] += c[k]
            whole = sum(c[0] for c in branch.values())
            few = {s: c for s, c in branch.items() if c[0] < U.PAGES or c[0] < U.SHARE * whole}
            pool = [sum(c[k] for c in few.values()) for k in range(3)]
            label = lambda s, n=len(branch): "*" if n == 1 and s in ("{n}", "{id}") else s
            step, own = {}, {}
            for s, c in branch.items():
                others = pool[1] - c[1], pool[2] - c[2]
                if s in few and len(few) >= U.BRANCHES and not (c[1] and others[0] and errors_apart(c[2], c[1], others[1], others[0]) >= U.STANDARD_ERRORS):
                    step[s] = "*"
                elif c[1]:
                    own[s] = c
                else:
                    step[s] = label(s)
            least = merged([c[1:] for c in own.values()])
            groups = defaultdict(list)
            for s, c in own.items():
                groups[least[c[2] / c[1]]].append(s)
            for of in groups.values():
                name = min(map(label, of))
                for s in of:
                    step[s] = f"{name} +{len(of) - 1}" if len(of) > 1 else name
            for host_, segments, c, _ in leaves:
                new = f"{template}/{step[segments[level]]}"
                if len(segments) == level + 1:
                    final[host_, "/".join(segments)] = new
                else:
                    todo.append((host_, segments, c, new))
        level += 1
    total = [sum(c[k] for c in counts.values()) for k in (1, 2)]
    prior = total[1] / total[0] if total[0] else 0.0
    sums = defaultdict(lambda: [0, 0])
    for key, (_, n, b) in counts.items():
        sums[key[0], final[key]][0] += n
        sums[key[0], final[key]][1] += b
    share = {k: (b + U.WEIGHT * prior) / (n + U.WEIGHT) if n else None for k, (n, b) in sums.items()}
    return {k: (t, share[k[0], t]) for k, t in final.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed):
    random.seed(seed)
    counts = {("h0.test", ""): (3, 1, 0)}
    for host in range(3):
        rate = {}
        for _ in range(160):
            segments = []
            for level in range(random.randint(1, 5)):
                segments.append(random.choice(["{n}", "{id}", *("abc"[:2]), *(f"v{i}" for i in range(40 if level == 1 else 2))]))
            n = random.choice([1, 2, 5, 40, 200])
            labelled = random.choice([0, 0, n // 2, n])
            p = rate.setdefault((segments[0], segments[-1]), random.choice([0.02, 0.1, 0.5, 0.9, 1.0]))
            counts[f"h{host}.test", "/".join(segments)] = (n, labelled, sum(random.random() < p for _ in range(labelled)))
    rows = spark.createDataFrame([(*k, *c) for k, c in counts.items()], "host string, shape string, n long, labelled long, bad long")
    got = {(r["host"], r["shape"]): (r["template"], r["share"]) for r in U.tree(rows).collect()}
    want = tree(counts)
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_planted_branches(spark):
    """Bad directories of many kinds among clean ones; few labels, some of them wrong."""
    random.seed(9)
    pages, labels, truth = [], [], {}

    def add(url, bad, known):
        truth[len(pages)] = bad
        pages.append((len(pages), url))
        if random.random() < known:
            labels.append((url, bad != (random.random() < 0.05)))

    for i in range(20):  # twenty sections of ten pages, all known, one of them bad
        for j in range(10):
            add(f"http://sections.test/s{'abcdefghijklmnopqrst'[i]}/{j}.html", i == 7, 1)
    for i in range(400):  # directories of a page each beside one large bad one
        add(f"http://flat.test/{'abcdefghijklmnopqrst'[i % 20]}{'abcdefghijklmnopqrst'[i // 20]}x/page", False, 0.3)
    for i in range(1000):
        add(f"http://flat.test/casino/{i}", True, 0.05)
    for i in range(300):  # below the fourth level
        add(f"http://deep.test/a/b/c/d/{'spam' if i % 3 == 0 else 'news'}/{i}.html", i % 3 == 0, 0.2)
    for i in range(600):  # users' directories, of which the bad ones lie under one section
        add(f"http://users.test/{'blogs' if i % 2 else 'ads'}/u{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}/post", i % 2 == 0, 0.1)
    got = {r["page_id"]: r["verdict"] == "block" for r in U.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "url string, bad boolean"), []).collect()}
    hit = sum(got[i] and truth[i] for i in truth)
    assert hit / sum(got.values()) >= 0.99 and hit / sum(truth.values()) >= 0.99


def test_labels_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://h/a/b"), (1, "http://h/a/b"), (2, None), (3, "http://h/*/x"), (4, "http://h/" + "a/" * 300)], "page_id long, url string")
    labels = spark.createDataFrame([("http://h/a/b", True, "clash")] * 40, "url string, bad boolean, host string")
    got = {(r["page_id"], r["verdict"]) for r in U.judge_urls(pages, labels, []).collect()}
    assert got == {(1, "block"), (2, "allow"), (3, "allow"), (4, "allow")}
    assert U.judge_urls(pages, labels.limit(0), []).where("verdict = 'block'").count() == 0
    assert U.judge_urls(pages.limit(0), labels, []).count() == 0
