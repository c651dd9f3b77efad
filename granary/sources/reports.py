"""Small report files and model exports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that a report may have: it is written by the driver.
MOST_ROWS = 1000


def write_report(df: DataFrame, title: str, path: str) -> None:
    """Writes path.json and path.md; refuses more than MOST_ROWS rows."""
    rows = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has {MOST_ROWS} rows at most")
    Path(f"{path}.json").write_text(json.dumps({"title": title, "rows": rows}, default=str, indent=1))
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    body = "\n".join("| " + " | ".join("" if r[c] is None else str(r[c]) for c in df.columns) + " |" for r in rows)
    Path(f"{path}.md").write_text(f"# {title}\n\n{head}\n{body}\n")


def tree_json(model, inputs: list[str]) -> dict:
    """The trees of a fitted ensemble as nested nodes, with the inputs' names."""

    def node(n):
        if n.numDescendants() == 0:
            return {"is_leaf": True, "value": n.prediction()}
        s = n.split()
        return {"is_leaf": False, "feature": inputs[s.featureIndex()], "threshold": s.threshold(), "left": node(n.leftChild()), "right": node(n.rightChild())}

    return {"inputs": inputs, "weights": list(model.treeWeights), "trees": [node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]}
