"""Expected schemas: semantic types, required columns and completeness, held against an audit."""

from __future__ import annotations

import json
import os


def _spec(x: object) -> dict:
    return {"type": x} if isinstance(x, str) else dict(x)


def load_schema(path: str) -> dict:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no schema file at {path}")
    with open(path, encoding="utf-8") as f:
        try:
            data = json.load(f)
        except json.JSONDecodeError as e:
            raise ValueError(f"schema file isn't JSON: {e}") from e
    if not isinstance(data, dict) or not ("columns" in data or "sheets" in data):
        raise ValueError("schema file needs `columns` or `sheets`")
    out = {"columns": {c: _spec(s) for c, s in data.get("columns", {}).items()}, "sheets": {}}
    for sheet, own in data.get("sheets", {}).items():
        out["sheets"][sheet] = {"columns": {c: _spec(s) for c, s in own.get("columns", own).items()}}
    return out


def expected(schema: dict, sheet: str) -> dict[str, dict]:
    """Column specifications of a sheet; its own ones replace the general ones."""
    return {**schema.get("columns", {}), **schema.get("sheets", {}).get(sheet, {}).get("columns", {})}


def validate_schema(sheet: dict, schema: dict, name: str = "") -> list[dict]:
    out = []
    for column, spec in expected(schema, name).items():
        have = sheet["fields"].get(column)
        if have is None:
            if spec.get("required"):
                out.append({"type": "schema_missing_column", "severity": "High", "column": column, "detail": {"expected": spec.get("type"), "actual": None}, "why": "A required column is absent; whatever reads it will fail."})
            continue
        kind, want = have["inferred_type"], spec.get("type")
        if want and want != kind:
            out.append({"type": "schema_type_mismatch", "severity": "High", "column": column, "detail": {"expected": want, "actual": kind}, "why": "The column's content isn't of the kind that is expected."})
        most, pct = spec.get("max_missing_pct"), have["null_analysis"]["missing_pct"]
        if most is not None and pct > most:
            out.append({"type": "schema_completeness_violation", "severity": "High" if pct > 2 * most else "Medium", "column": column, "detail": {"max_missing_pct": most, "actual_missing_pct": pct}, "why": "More cells are missing than the schema allows."})
    return out


def generate_schema(results: dict) -> dict:
    columns: dict[str, dict] = {}
    for sheet in results["sheets"].values():
        for column, f in sheet["fields"].items():
            columns.setdefault(column, {"type": f["inferred_type"], "required": False})
    return {"columns": columns}
