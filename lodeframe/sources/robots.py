"""robots.txt rules: groups of one agent merged, wildcards, first match in order."""

from __future__ import annotations

import re
from urllib.parse import urlsplit


class Robots:
    """Rules by agent token; a URL is matched with its query."""

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[bool, re.Pattern[str]]]] = {}
        heads: list[str] = []
        open_ = False
        for raw in text.splitlines():
            name, colon, value = raw.partition("#")[0].partition(":")
            name, value = name.strip().lower(), value.strip()
            if not colon:
                continue
            if name == "user-agent":
                heads = [value.lower()] if open_ else [*heads, value.lower()]
                open_ = False
                self.rules.setdefault(value.lower(), [])
            elif name in ("allow", "disallow") and heads:
                open_ = True
                for head in dict.fromkeys(heads):
                    self.rules[head].append((name == "allow" or not value, self.pattern(value)))

    @staticmethod
    def pattern(value: str) -> re.Pattern[str]:
        end = value.endswith("$")
        return re.compile(".*".join(map(re.escape, value.removesuffix("$").split("*"))) + (r"\Z" if end else ""))

    def allows(self, agent: str, url: str) -> bool:
        token = agent.partition("/")[0].lower()
        own = next((r for head, r in self.rules.items() if head != "*" and head in token), self.rules.get("*", []))
        parts = urlsplit(url)
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        return next((allow for allow, pattern in own if pattern.match(target)), True)
