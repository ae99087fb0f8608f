import json
import random

from lodestrata.streaming import history


def test_state_of_idle_keys_goes(spark, tmp_path):
    """Answers equal one pass over all hits, and keys leave the state once their window is over."""
    rng = random.Random(1)
    batches, at = [], 0.0
    for n in range(5):
        at += 1000.0 * (n == 3)
        batches.append([(f"k{rng.randrange(6)}" if n < 3 else "late", at + n * 20 + rng.random() * 20) for _ in range(40)])
    folder, out = tmp_path / "hits", tmp_path / "out"
    folder.mkdir()
    sizes = []
    for n, batch in enumerate(batches):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"key": k, "time": t}) for k, t in batch))
        stream = history.limited(spark.readStream.schema("key string, time double").json(f"file://{folder}"), 3, 10.0)
        query = stream.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    want = []
    for k in {k for b in batches for k, _ in b}:
        times = sorted(t for b in batches for x, t in b if x == k)
        want += zip([k] * len(times), times, history.allowed(times, [], 3, 10.0)[0])
    got = [tuple(r) for r in spark.read.parquet(f"file://{out}").collect()]
    assert sorted(got) == sorted(want) and {ok for _, _, ok in got} == {True, False}
    assert max(sizes[:3]) >= 5 and sizes[-1] == 1
