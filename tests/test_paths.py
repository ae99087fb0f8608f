import random
from collections import deque

from lodestrata.operators import ownership, paths
from lodestrata.plans import proxy


def plain(rows, a, b, most):
    """Edges of a shortest path, breadth first; None beyond most."""
    near = {}
    for e, p in rows:
        near.setdefault(("a", e), set()).add(("f", p))
        near.setdefault(("f", p), set()).add(("a", e))
    if ("a", a) not in near or ("a", b) not in near:
        return None
    far, todo = {("a", a): 0}, deque([("a", a)])
    while todo:
        at = todo.popleft()
        for x in near[at] - far.keys():
            far[x] = far[at] + 1
            todo.append(x)
    d = far.get(("a", b))
    return d if d is not None and d <= most else None


def test_shortest_paths_by_breadth_first_search(spark):
    rng = random.Random(2)
    for size, files in ((6, 5), (14, 13), (20, 26)):
        rows = [(f"a{rng.randrange(size):02}", f"f{rng.randrange(files):02}") for _ in range(size + files // 2)]
        rows += [(rows[0][0], rows[0][1]), (None, "f00"), ("a00", None)]
        touched = spark.createDataFrame(rows, "email string, path string")
        known = [r for r in rows if None not in r]
        for _ in range(3):
            a, b = (f"a{rng.randrange(size):02}" for _ in range(2))
            found, want = paths.shortest(touched, a, b), plain(known, a, b, 12)
            assert (None if found is None else len(found) - 1) == want, (a, b, rows)
            if found:
                assert found[0] == a and found[-1] == b
                assert all((found[i], found[i + 1]) in known and (found[i + 2], found[i + 1]) in known for i in range(0, len(found) - 2, 2))


def test_a_chain_as_long_as_the_bound(spark):
    rows = [(f"a{i}", f"f{i + k}") for i in range(7) for k in (0, 1)]
    touched = spark.createDataFrame(rows, "email string, path string")
    assert paths.shortest(touched, "a0", "a6") == [x for i in range(7) for x in (f"a{i}", f"f{i + 1}")][:-1]
    assert paths.shortest(touched, "a0", "a6", 10) is None and paths.shortest(touched, "a0", "nobody") is None
    assert paths.shortest(touched, "a0", "a0") == ["a0"] and paths.steps(touched, "a0", "x").count() == 0


def test_the_first_tiers_are_the_connections(spark, sf_small):
    g = proxy.graph(spark, sf_small)
    touched = g.touches.selectExpr("author_email as email", "path")
    for other in ("n7", "n11"):
        want = ownership.author_path(g, "n3", other)
        assert paths.shortest(touched, "n3", other) == [s[1] for s in want["steps"]]
    few = touched.where("crc32(concat(email, path)) % 12 = 0")  # in which some have no file in common
    sparse = proxy.graph(spark, sf_small)
    sparse.modified = g.modified.join(g.commit.selectExpr("hash", "author_email as email"), "hash").join(few.distinct(), ["email", "path"], "left_semi").drop("email")
    tried = set()
    for a, b in (("n3", "n7"), ("n1", "n2"), ("n0", "n24"), ("n5", "n9")):
        want, got = ownership.author_path(sparse, a, b), paths.shortest(few, a, b)
        if want["found"]:
            assert got == [s[1] for s in want["steps"]]
            tried.add(want["hops"])
        else:
            assert got is None or len(got) > 5
    assert 4 in tried
