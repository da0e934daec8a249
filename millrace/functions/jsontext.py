"""JSON objects inside free text, and the check of an extraction, for one Arrow UDF."""

from __future__ import annotations

import json
import math

# Fixed values of the schema.
TASKS = ("classification", "generation", "retrieval", "reasoning", "multimodal", "agent", "other")
MODALITIES = ("text", "image", "audio", "video", "code")
FIELDS = ("task_type", "modalities", "benchmarks", "open_source", "claims_sota", "method_keywords", "one_line_summary", "limitation_mentioned")
TRUE, FALSE = {"1", "on", "t", "true", "y", "yes"}, {"0", "off", "f", "false", "n", "no"}
VALID, SOFT, INVALID = "VALID", "SOFT_VIOLATION", "INVALID"


def objects(text: str) -> list[str]:
    """All balanced objects that are not inside one another, in order; quotes and escapes are heeded.

    One pass finds the partners of all braces it sees outside quotes, so a brace that closes nowhere costs no new
    pass; only braces that lay inside a quote of an earlier pass need their own.
    """
    partner: dict[int, int | None] = {}
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        if start not in partner:
            stack: list[int] = []
            quoted = escaped = False
            for i in range(start, len(text)):
                c = text[i]
                if quoted:
                    if escaped:
                        escaped = False
                    elif c == "\\":
                        escaped = True
                    elif c == '"':
                        quoted = False
                elif c == '"':
                    quoted = True
                elif c == "{":
                    stack.append(i)
                    partner.setdefault(i, None)
                elif c == "}" and stack:
                    partner[stack.pop()] = i
                    if not stack:
                        break
        end = partner[start]
        if end is None:
            at = start + 1
        else:
            out.append(text[start : end + 1])
            at = end + 1
    return out


def chosen(text: str) -> str | None:
    """The last object that parses, else the last one, else None."""
    found = objects(text)
    for s in reversed(found):
        try:
            json.loads(s)
            return s
        except (ValueError, RecursionError):
            continue
    return found[-1] if found else None


def repeated_keys(text: str) -> bool:
    """Whether a key stands twice at the top level; text that does not parse counts as such."""
    seen: list[list] = []
    try:
        json.loads(text, object_pairs_hook=lambda pairs: seen.append([k for k, _ in pairs]) or dict(pairs))
    except (ValueError, RecursionError):
        return True
    return bool(seen) and len(seen[-1]) != len(set(seen[-1]))


def boolean(x) -> bool | None:
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return bool(x) if x in (0, 1) else None
    word = x.lower() if isinstance(x, str) else ""
    return True if word in TRUE else False if word in FALSE else None


def checked(obj) -> dict:
    """status, errors, soft flags and the cast extraction of a parsed value."""
    if not isinstance(obj, dict):
        return {"status": INVALID, "errors": [f"not a JSON object: {type(obj).__name__}"], "soft_flags": [], "parsed": None}
    errors, got = [f"{k}: extra" for k in obj if k not in FIELDS], {}
    for field in FIELDS:
        if field not in obj:
            errors.append(f"{field}: missing")
            continue
        x = obj[field]
        if field == "task_type":
            x = x.strip().lower() if isinstance(x, str) else x
            if x not in TASKS:
                errors.append("task_type: not in the list")
        elif field in ("open_source", "claims_sota"):
            x = boolean(x)
            if x is None:
                errors.append(f"{field}: not a boolean")
        elif field == "one_line_summary":
            if not isinstance(x, str):
                errors.append("one_line_summary: not a text")
        elif field == "limitation_mentioned":
            if x is not None and not isinstance(x, str):
                errors.append("limitation_mentioned: not a text")
        elif not isinstance(x, list):
            errors.append(f"{field}: not a list")
        elif field == "modalities":
            x = [m.strip().lower() if isinstance(m, str) else m for m in x]
            errors += [f"modalities.{i}: not in the list" for i, m in enumerate(x) if m not in MODALITIES]
        elif field == "method_keywords":
            errors += [f"method_keywords.{i}: not a text" for i, k in enumerate(x) if not isinstance(k, str)]
            x = [k.strip() if isinstance(k, str) else k for k in x]
        else:
            x = [triple(t, f"benchmarks.{i}", errors) for i, t in enumerate(x)]
        got[field] = x
    if errors:
        return {"status": INVALID, "errors": errors, "soft_flags": [], "parsed": None}
    soft = [f"method_keywords: {len(got['method_keywords'])} not in 3-5"] if not 3 <= len(got["method_keywords"]) <= 5 else []
    soft += ["modalities: empty"] if not got["modalities"] else ["modalities: repeated"] if len(set(got["modalities"])) < len(got["modalities"]) else []
    soft += [f"benchmarks.{i}.value: a text" for i, t in enumerate(got["benchmarks"]) if t["value_str"] is not None]
    return {"status": SOFT if soft else VALID, "errors": [], "soft_flags": soft, "parsed": got}


def triple(t, where: str, errors: list[str]) -> dict | None:
    """One result with its value as number or text; truth values and infinite numbers become texts."""
    if not isinstance(t, dict):
        errors.append(f"{where}: not an object")
        return None
    errors += [f"{where}.{k}: extra" for k in t if k not in ("name", "metric", "value")]
    errors += [f"{where}.{k}: missing" for k in ("name", "metric", "value") if k not in t]
    errors += [f"{where}.{k}: not a text" for k in ("name", "metric") if k in t and not isinstance(t[k], str)]
    x = t.get("value")
    if isinstance(x, bool):
        x = str(x).lower()
    elif isinstance(x, float) and not math.isfinite(x):
        x = str(x)
    if "value" in t and not isinstance(x, (int, float, str)):
        errors.append(f"{where}.value: not a value")
    number = isinstance(x, (int, float))
    try:
        return {"name": t.get("name"), "metric": t.get("metric"), "value_num": float(x) if number else None, "value_str": x if isinstance(x, str) else None}
    except OverflowError:
        return {"name": t.get("name"), "metric": t.get("metric"), "value_num": None, "value_str": str(x)}


def read(text: str | None) -> dict:
    """gate (null if passed), duplicate keys, and checked() of the object in a text."""
    raw = chosen(text or "")
    if raw is None:
        return {"gate": "no_json", "repeated": False} | checked(None)
    try:
        obj = json.loads(raw)
    except (ValueError, RecursionError):
        return {"gate": "parse_fail", "repeated": False} | checked(None)
    twice, result = repeated_keys(raw), checked(obj)
    return {"gate": "duplicate_keys" if twice else "schema_invalid" if result["status"] == INVALID else None, "repeated": twice} | result
