"""A row-at-a-time model of the redaction and streaming rules, for comparison only."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from veilframe.functions.rules import RULES, SENSITIVE_KEYS

SPACES = (
    r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def token(label: str, value: str) -> str:
    return f"[{label}_{hashlib.sha256(value.encode()).hexdigest()[:6]}]"


def compiled(rule):
    pattern = rule.pattern.replace(r"[\s\S]", r"(?s:.)")
    pattern = pattern.replace(r"[\s:;]", f"[{SPACES}:;]").replace(r"\s", f"[{SPACES}]")
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


PATTERNS = [(r, compiled(r)) for r in RULES]


def redact(text: str | None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The redacted text and the findings, in order."""
    found: list[tuple[str, str, str]] = []
    if text is None:
        return None, found
    for rule, pattern in PATTERNS:

        def swap(m: re.Match, rule=rule) -> str:
            value = m.group(rule.group)
            tok = token(rule.label, value)
            found.append((rule.label, value, tok))
            return m.group().replace(value, tok, 1)

        text = pattern.sub(swap, text)
    return text, found


def redact_tree(node: Any, key: str | None, found: list) -> Any:
    if isinstance(node, str):
        flat = (key or "").lower().replace("-", "").replace("_", "")
        if key and any(k in flat for k in SENSITIVE_KEYS):
            tok = token("SENSITIVE_SECRET", node)
            found.append(("SENSITIVE_SECRET", node, tok))
            return tok
        text, more = redact(node)
        found.extend(more)
        return text
    if isinstance(node, list):
        return [redact_tree(x, None, found) for x in node]
    if isinstance(node, dict):
        return {k: redact_tree(v, k, found) for k, v in node.items()}
    return node


def rehydrate(text: str, vault: dict[str, str]) -> str:
    for tok, value in vault.items():
        text = value.join(text.split(tok))
    return text


def rehydrate_tree(node: Any, vault: dict[str, str]) -> Any:
    if isinstance(node, str):
        return rehydrate(node, vault)
    if isinstance(node, list):
        return [rehydrate_tree(x, vault) for x in node]
    if isinstance(node, dict):
        return {k: rehydrate_tree(v, vault) for k, v in node.items()}
    return node


def raw_stream(chunks: list[str], vault: dict[str, str]) -> list[str]:
    """What a raw chunk stream emits, by checking every prefix of every token."""
    buffer, out = "", []
    for chunk in chunks:
        buffer += chunk
        hold = max(
            (n for t in vault for n in range(1, len(t)) if buffer.endswith(t[:n])), default=0
        )
        cut = len(buffer) - hold
        out.append(rehydrate(buffer[:cut], vault))
        buffer = buffer[cut:]
    return out


def sse_stream(chunks: list[str], vault: dict[str, str]) -> list[str]:
    """What an event stream emits chunk by chunk."""
    longest = max((len(t) for t in vault), default=0)
    buffer, fields, out = "", {}, []
    for chunk in chunks:
        buffer += chunk
        if "data: " not in buffer:
            hold = max(
                (n for t in vault for n in range(1, len(t)) if buffer.endswith(t[:n])), default=0
            )
            cut = len(buffer) - hold
            out.append(rehydrate(buffer[:cut], vault))
            buffer = buffer[cut:]
            continue
        done, newline, rest = buffer.rpartition("\n")
        if not newline:
            out.append("")
            continue
        buffer = rest
        shown = []
        for line in done.split("\n"):
            if not line.startswith("data: ") or line.strip() == "data: [DONE]":
                shown.append(line)
                continue
            try:
                event = json.loads(line[6:])
            except ValueError:
                shown.append(rehydrate(line, vault))
                continue
            choices = event.get("choices") or [{}]
            delta = choices[0].get("delta") or event.get("delta")
            if not delta:
                event = rehydrate_tree(event, vault)
            else:
                for name in ("content", "reasoning_content", "partial_json"):
                    if not isinstance(delta.get(name), str):
                        name = "text" if name == "content" else name
                    if not isinstance(delta.get(name), str):
                        continue
                    text = fields.get(name, "") + delta[name]
                    at = text.rfind("[")
                    tail = text[at:] if at >= 0 else ""
                    wait = tail and "]" not in tail and len(tail) < longest and (
                        tail == "[" or re.match(r"\[[A-Z_]", tail)
                    )
                    cut = at if wait else len(text)
                    delta[name] = rehydrate(text[:cut], vault)
                    fields[name] = text[cut:]
            shown.append("data: " + json.dumps(event, ensure_ascii=False, separators=(",", ":")))
        out.append("\n".join(shown) + "\n")
    return out
