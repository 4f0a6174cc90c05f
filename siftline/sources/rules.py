"""Rules and rulesets from YAML files, selection, and lint."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from siftline.functions import ids, patterns

HERE = Path(__file__).resolve().parent.parent / "data"
ID = re.compile(r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*")
LONGEST_ID = 20


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    description: str | None = None
    examples: tuple[str, ...] = ()
    negative_examples: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()

    @property
    def structural_id(self) -> str:
        return ids.rule_id(self.pattern)


@dataclass(frozen=True)
class Ruleset:
    id: str
    name: str
    description: str
    include_rule_ids: tuple[str, ...] = ()


@dataclass
class Rules:
    """Rules by id (the later file wins) and rulesets by id; ``repeated``: ids that were loaded more than once."""

    rules: dict[str, Rule] = field(default_factory=dict)
    rulesets: dict[str, Ruleset] = field(default_factory=dict)
    repeated: list[str] = field(default_factory=list)

    def load(self, *paths: str | os.PathLike) -> Rules:
        """Adds the rules of files, or of all *.yml and *.yaml below directories in order of name."""
        for path in map(Path, paths):
            files = sorted(p for p in path.rglob("*") if p.suffix in (".yml", ".yaml")) if path.is_dir() else [path]
            for file in files:
                doc = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
                for raw in doc.get("rules") or []:
                    self.repeated += [raw["id"]] * (raw["id"] in self.rules)
                    lists = {k: tuple(raw.get(k) or ()) for k in ("examples", "negative_examples", "references", "categories")}
                    self.rules[raw["id"]] = Rule(raw["id"], raw["name"], raw["pattern"], raw.get("description"), **lists)
                for raw in doc.get("rulesets") or []:
                    self.repeated += [raw["id"]] * (raw["id"] in self.rulesets)
                    self.rulesets[raw["id"]] = Ruleset(raw["id"], raw["name"], raw.get("description", ""), tuple(raw.get("include_rule_ids") or ()))
        return self

    def select(self, *rulesets: str) -> list[Rule]:
        """Rules of the named rulesets in order of id; ``all`` stands for every rule."""
        chosen: set[str] = set()
        for name in sorted(set(rulesets)):
            if name == "all":
                chosen.update(self.rules)
            elif name in self.rulesets:
                chosen.update(self.rulesets[name].include_rule_ids)
            else:
                raise ValueError(f"unknown ruleset {name!r}")
        if missing := sorted(chosen - self.rules.keys()):
            raise ValueError(f"unknown rules {missing}")
        if not chosen:
            raise ValueError("no rules are selected")
        return [self.rules[i] for i in sorted(chosen)]


def builtin() -> Rules:
    """The built-in rules, each with an example that is made from its pattern."""
    known = Rules().load(HERE / "rules.yml")
    for r in known.rules.values():
        made = patterns.example(r.pattern)
        known.rules[r.id] = replace(r, examples=r.examples or ((made,) if made else ()))
    return known


def demo() -> list[Rule]:
    return Rules().load(HERE / "demo_rules.yml").select("demo")


RULE = "rule_structural_id string, name string, text_id string, pattern string, categories array<string>, syntax string"


def frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row for each rule; ``syntax`` is its JSON."""
    import json

    rows = []
    for r in rules:
        syntax = {"name": r.name, "id": r.id, "pattern": r.pattern}
        syntax |= {"description": r.description} if r.description is not None else {}
        syntax |= {k: list(getattr(r, k)) for k in ("examples", "negative_examples", "references", "categories")}
        rows.append((r.structural_id, r.name, r.id, r.pattern, list(r.categories), json.dumps(syntax, separators=(",", ":"), ensure_ascii=False)))
    return spark.createDataFrame(rows, RULE)


def lint(rules: Rules, pedantic: bool = False) -> list[tuple[str, str, str]]:
    """(level, rule or ruleset id, problem): what is wrong with a set of rules."""
    from siftline.operators.scan import find

    found: list[tuple[str, str, str]] = []
    for r in rules.rules.values():
        def say(level: str, text: str, where: str = r.id) -> None:
            found.append((level, where, text))

        if not ID.fullmatch(r.id):
            say("error", "malformed id")
        if len(r.id) > LONGEST_ID:
            say("error", f"id longer than {LONGEST_ID} characters")
        if not r.examples:
            say("warning", "no examples")
        if pedantic and not r.description:
            say("warning", "no description")
        try:
            regex = patterns.compiled(r.pattern)
        except re.error as e:
            say("error", f"pattern does not compile: {e}")
            continue
        if not regex.groups:
            say("error", "no capture group")
        needed = patterns.literals(r.pattern)
        for wanted, examples in ((True, r.examples), (False, r.negative_examples)):
            for i, text in enumerate(examples):
                raw = text.encode()
                hit = bool(find(regex, raw)) and (needed is None or any(x in raw.lower() for x in needed))
                if hit != wanted:
                    say("error", f"{'example' if wanted else 'negative example'} {i} {'does not match' if wanted else 'matches'}")
    found += [("error", i, "id used more than once") for i in sorted(set(rules.repeated))]
    used = {i for s in rules.rulesets.values() for i in s.include_rule_ids}
    for s in rules.rulesets.values():
        found += [("error", s.id, f"unknown rule {i}") for i in s.include_rule_ids if i not in rules.rules]
        found += [("warning", s.id, f"rule {i} listed twice") for i in sorted({i for i in s.include_rule_ids if s.include_rule_ids.count(i) > 1})]
    found += [("warning", i, "in no ruleset") for i in sorted(rules.rules.keys() - used)]
    return found


