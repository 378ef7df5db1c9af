"""The rules of a page's style sheets that decide whether an element is seen."""

from __future__ import annotations

import re

PROPERTIES = frozenset({"display", "visibility", "opacity"})
_NAME = r"[A-Za-z0-9_\u0080-￿-]+"
_SIMPLE = re.compile(rf"(?P<any>\*)|(?P<tag>{_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]*))\s*)?\]")
_BLOCK = re.compile(r"([^{}]*)\{([^{}]*)\}")


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """The last declaration of each property that counts, an important one before others: (important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in PROPERTIES and value:
            important = value.endswith("!important")
            if important or not out.get(name, (False, ""))[0]:
                out[name] = (important, value.removesuffix("!important").strip())
    return out


def _compound(text: str) -> list[tuple] | None:
    """The conditions of a selector without combinators; None where some are of another kind."""
    found, at = [], 0
    for m in _SIMPLE.finditer(text):
        if m.start() != at or (m["tag"] and at):
            return None
        value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), None)
        found.append(("tag", m["tag"].lower()) if m["tag"] else ("id", m["id"]) if m["id"] else ("cls", m["cls"]) if m["cls"] else ("attr", m["attr"].lower(), m["op"], value) if m["attr"] else ("any",))
        at = m.end()
    return found if at == len(text) and found else None


def _meets(e: dict, conditions: list[tuple]) -> bool:
    own = e["attrs"]
    for kind, *rest in conditions:
        if kind == "tag" and e["tag"] != rest[0] or kind == "id" and own.get("id") != rest[0] or kind == "cls" and rest[0] not in own.get("class", "").split():
            return False
        if kind == "attr":
            name, op, want = rest
            has = own.get(name)
            if has is None or op and not {"=": has == want, "^=": bool(want) and has.startswith(want), "$=": bool(want) and has.endswith(want), "*=": bool(want) and want in has, "~=": want in has.split(), "|=": has == want or has.startswith(f"{want}-")}[op]:
                return False
    return True


class Sheet:
    """Rules of the style elements of one tree, kept by what their last part asks for first.

    Selectors are compounds of tags, ids, classes and attributes, joined by blanks or >. Rules with other selectors
    (states, siblings) and those inside of at-rules (media) do not count.
    """

    def __init__(self):
        self._by: dict[tuple, list] = {}
        self._count = 0

    def read(self, text: str) -> None:
        text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
        depth, plain, start = 0, [], 0
        for m in re.finditer(r"@[^;{}]*(;|\{)|[{}]", text):  # blocks of at-rules are left out
            if depth:
                depth += {"{": 1, "}": -1}.get(m[0][-1], 0)
                start = m.end()
            elif m[0][0] == "@":
                plain.append(text[start : m.start()])
                depth, start = int(m[1] == "{"), m.end()
        plain.append("" if depth else text[start:])
        for selectors, body in _BLOCK.findall("".join(plain)):
            found = declarations(body)
            for selector in selectors.split(",") if found else ():
                parts = [p for p in re.split(r"\s*(>)\s*|\s+", selector.strip()) if p]
                steps = [p if p == ">" else _compound(p) for p in parts]
                if not steps or None in steps or steps[-1] == ">" or steps[0] == ">":
                    continue
                flat = [c for s in steps if s != ">" for c in s]
                weight = tuple(sum(c[0] in kinds for c in flat) for kinds in (("id",), ("cls", "attr"), ("tag",)))
                key = next((c for k in ("id", "cls", "tag") for c in steps[-1] if c[0] == k), ("any",))
                self._count += 1
                self._by.setdefault(key, []).append((weight, self._count, steps, found))

    def style(self, e: dict, elements: list[dict]) -> dict[str, str]:
        """The properties that rules and the element's own style give it."""
        best: dict[str, tuple] = {}
        own = e["attrs"]
        keys = [("any",), ("tag", e["tag"]), ("id", own.get("id")), *(("cls", c) for c in dict.fromkeys(own.get("class", "").split()))] if self._by else []
        for key in keys:
            for weight, order, steps, found in self._by.get(key, ()):
                if self._applies(e, elements, steps):
                    for name, (important, value) in found.items():
                        best[name] = max(best.get(name, ()), (important, (0, *weight), order, value))
        for name, (important, value) in declarations(own.get("style", "")).items():
            best[name] = max(best.get(name, ()), (important, (1,), 0, value))
        return {name: x[-1] for name, x in best.items()}

    @staticmethod
    def _applies(e: dict, elements: list[dict], steps: list) -> bool:
        """Whether the selector holds: from its end, an element for each part, the nearest that fits where a blank joins them."""
        if not _meets(e, steps[-1]):
            return False
        up, i = e["parent"], len(steps) - 2
        while i >= 0:
            direct = steps[i] == ">"
            i -= direct
            while up is not None and not _meets(elements[up], steps[i]):
                if direct:
                    return False
                up = elements[up]["parent"]
            if up is None:
                return False
            up, i = elements[up]["parent"], i - 1
        return True
