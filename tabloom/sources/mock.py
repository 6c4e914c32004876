"""A synthetic prediction task: two training tables, one to predict, a sample and a description."""

from __future__ import annotations

import random
from pathlib import Path

FILES = ("train/target.csv", "train/features.csv", "val/features.csv", "sample_submission.csv", "DATA_DESCRIPTION.md")
DESCRIPTION = """# Mock data

- Training target: `train/target.csv`, training features: `train/features.csv`
- Prediction features: `val/features.csv`, sample: `sample_submission.csv`
- Row id: `row_id`. Target: `target_value`. Score: mean absolute error.
- Rows merge on entity_id and time_key
- Optional block/category column: segment
"""


def create_mock(root: str | Path, seed: int = 42, train: int = 120, predict: int = 30) -> Path:
    """Write the task below root/data, replacing only its own files; the same values each time."""
    rng = random.Random(seed)
    data = Path(root) / "data"
    for f in FILES:
        (data / f).unlink(missing_ok=True)
        (data / f).parent.mkdir(parents=True, exist_ok=True)

    def features(first: int, n: int, no_first: int, no_second: int, no_text: int) -> list[list]:
        rows = []
        for i in range(n):
            rows.append([
                first + i, 2020 + i % 6, f"group_{'abc'[i % 3]}", round(rng.gauss(10, 3), 3), round(rng.gauss(0, 1), 3), rng.choice(["low", "medium", "high"]),
                f"note {rng.randint(0, 10**6)} on item", f"{2020 + i % 6}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            ])
        for column, gone in ((3, no_first), (4, no_second), (6, no_text)):
            for i in rng.sample(range(n), gone):
                rows[i][column] = ""
        return rows

    header = "entity_id,time_key,segment,numeric_feature_1,numeric_feature_2,categorical_feature,text_feature,event_date"
    write = lambda name, head, rows: (data / name).write_text("\n".join([head, *[",".join(map(str, r)) for r in rows]]) + "\n")
    old, new = features(1, train, train // 8, train // 17, train // 10), features(1001, predict, predict // 10, predict // 30, predict // 10)
    write(FILES[1], header, old)
    write(FILES[2], header, new)
    target = [[*r[:3], round(max(0.0, 5 + (r[3] or 10) * 0.8 + {"low": 0, "medium": 2, "high": 5}[r[5]] + rng.gauss(0, 1)), 3)] for r in old]
    write(FILES[0], "entity_id,time_key,segment,target_value", target)
    write(FILES[3], "row_id,entity_id,time_key,segment,target_value", [[k + 1, *r[:3], 0.0] for k, r in enumerate(new)])
    (data / FILES[4]).write_text(DESCRIPTION)
    return data
