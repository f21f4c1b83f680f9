"""What the driver holds: the entries of the fitted machine are gathered in parts, and loops leave it few tasks to keep notes of."""

import tracemalloc

import numpy as np

from palate.llm import simhash, toxicity


def test_the_fit_gathers_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 2000, rng.integers(0, 60))).astype(np.int32) for _ in range(6000)]
    y = (rng.random(len(rows)) < 0.2).astype(float)
    monkeypatch.setattr(toxicity, "STEPS", 3)
    fits, entries = [], sum(map(len, rows))
    for part in (1 << 40, 1 << 12, 1):
        monkeypatch.setattr(toxicity, "GATHERED", part, raising=False)
        tracemalloc.start()
        fits.append(toxicity.fit_machine(rows, y, 2000))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert part != 1 << 12 or peak < 40 * entries  # seven doubles an entry and its four indices were 86 bytes
    for fit in fits[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(fits[0], fit, strict=True))


def test_rounds_of_components_launch_few_tasks(spark):
    n = 40
    pairs = [(k, k + 1) for k in range(0, 12)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201)]
    held = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "tasks of the rounds")
        got = dict(simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numTasks for s in stages if (x := tracker.getStageInfo(s)) and x.numCompletedTasks)
        sums = sum(x.numCompletedTasks == 1 for s in stages if (x := tracker.getStageInfo(s)))  # each look at a round's edges ends in one task
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(13), 0) | dict.fromkeys(range(100, 130), 100) | {200: 200, 201: 200}
    print("tasks", tasks, "sums", sums)
    assert tasks < 10 * n * sums
