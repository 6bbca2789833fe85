"""The user's lists: rules and terms, and hosts on which pages are or are not judged."""

from __future__ import annotations

from dataclasses import dataclass, replace

from gleaner.plans import values as V


def normal_rule(rule: str) -> str:
    return " ".join(rule.split())[: V.RULE_CHARS].strip()


def distinct_rules(rules: list[str], most: int) -> list[str]:
    """Rules as they are asked: normalised, the first spelling of each, in the user's order, up to ``most``."""
    first = {}
    for rule in map(normal_rule, rules):
        if rule:
            first.setdefault(rule.lower(), rule)
    return list(first.values())[:most]


def find_rule(rules: list[str], rule: str) -> str | None:
    """The user's spelling of a rule."""
    return next((x for x in rules if x.lower() == normal_rule(rule).lower()), None)


def normal_host(host: str) -> str:
    return host.strip().lower().removeprefix("www.")


def covered(host: str, rules: tuple[str, ...] | list[str]) -> bool:
    labels = host.split(".")
    return any(".".join(labels[i:]) in rules for i in range(len(labels)))


@dataclass(frozen=True)
class Hosts:
    """allowed: hosts that are always judged; denied: hosts that never are. Lists stay minimal: no host is on one without need."""

    allowed: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()

    def enabled(self, host: str) -> bool:
        h = normal_host(host)
        return bool(h) and (covered(h, self.allowed) or not covered(h, self.denied) and not covered(h, V.DENIED_HOSTS))

    def always(self, host: str) -> bool:
        h = normal_host(host)
        return bool(h) and covered(h, self.allowed)

    def without(self, host: str) -> Hosts:
        return replace(self, allowed=tuple(x for x in self.allowed if x != host), denied=tuple(x for x in self.denied if x != host))

    def switch(self, host: str, on: bool) -> Hosts:
        """Turns a host on or off; turning one off and on again leaves no trace."""
        h = normal_host(host)
        rest = self.without(h)
        if not h:
            return self
        if not on:
            return replace(rest, denied=(*rest.denied, h))
        return rest if rest.enabled(h) else replace(rest, allowed=(*rest.allowed, h))

    def keep_always(self, host: str, on: bool) -> Hosts:
        h = normal_host(host)
        if not h:
            return self
        if on:
            rest = self.without(h)
            return replace(rest, allowed=(*rest.allowed, h))
        return replace(self, allowed=tuple(x for x in self.allowed if x != h))
