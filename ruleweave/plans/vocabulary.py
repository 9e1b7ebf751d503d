"""The closed vocabulary of a domain: which predicates are observed, which are derived, and how they read in words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ruleweave.plans.rules import Atom, Rule

OBSERVABLE, DERIVED = "observable", "derived"
SCHEMA = "signature string, name string, arity int, kind string, phrase string, description string, askable boolean, arg_types array<string>"


@dataclass(frozen=True)
class Predicate:
    name: str
    arity: int = 1
    kind: str = OBSERVABLE
    phrase: str = ""
    description: str = ""
    askable: bool = True
    arg_types: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in (OBSERVABLE, DERIVED):
            raise ValueError(f"{self.name}: kind must be observable or derived")
        if self.arg_types and len(self.arg_types) != self.arity:
            raise ValueError(f"{self.name}: {len(self.arg_types)} argument types for {self.arity} arguments")

    @property
    def signature(self) -> str:
        return f"{self.name}/{self.arity}"


class Vocabulary:
    def __init__(self, predicates: list[Predicate]):
        self.predicates: dict[str, Predicate] = {}
        for p in predicates:
            if p.signature in self.predicates:
                raise ValueError(f"{p.signature} is declared twice")
            self.predicates[p.signature] = p

    def observables(self) -> list[Predicate]:
        return [p for p in self.predicates.values() if p.kind == OBSERVABLE]

    def askable(self) -> set[str]:
        """Signatures whose unrecorded atoms are unknown."""
        return {p.signature for p in self.observables() if p.askable}

    def problems(self, rule: Rule) -> list[str]:
        """What stands against a rule: undeclared predicates, and a head that is observed."""
        found = [f"{a.signature} is not declared" for a in (rule.head, *(x.atom for x in rule.body)) if a.signature not in self.predicates]
        head = self.predicates.get(rule.head.signature)
        if head and head.kind == OBSERVABLE:
            found.append(f"{head.signature} is observed and can't be concluded")
        return list(dict.fromkeys(found))

    def fact_problem(self, atom: Atom) -> str | None:
        """What stands against an asserted fact."""
        p = self.predicates.get(atom.signature)
        return f"{atom.signature} is not declared" if p is None else f"{atom.signature} is derived and can't be asserted" if p.kind == DERIVED else None

    def phrase(self, atom: Atom) -> str:
        """An atom in words: the predicate's phrase with its terms, or the atom itself."""
        p = self.predicates.get(atom.signature)
        try:
            return p.phrase.format(*map(str, atom.terms)) if p and p.phrase else str(atom)
        except (IndexError, KeyError, ValueError):
            return str(atom)

    def split(self, rules: list[Rule]) -> tuple[list[Rule], list[tuple[Rule, list[str]]]]:
        """Rules without problems, and the others with theirs."""
        judged = [(r, self.problems(r)) for r in rules]
        return [r for r, found in judged if not found], [(r, found) for r, found in judged if found]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(p.signature, p.name, p.arity, p.kind, p.phrase, p.description, p.askable, list(p.arg_types)) for p in self.predicates.values()]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        rows = spark.read.schema(SCHEMA).parquet(path).orderBy("signature").collect()
        return cls([Predicate(r.name, r.arity, r.kind, r.phrase or "", r.description or "", r.askable, tuple(r.arg_types or ())) for r in rows])


def inferred(rules: list[Rule], most: int = 24) -> Vocabulary:
    """An open vocabulary: what rule bodies mention and no rule concludes, as observables, and the heads as derived."""
    heads = {r.head.signature: r.head for r in rules}
    seen = {x.atom.signature: x.atom for r in rules for x in r.body if x.atom.signature not in heads}
    observed = [Predicate(a.predicate, len(a.terms)) for _, a in sorted(seen.items())][:most]
    return Vocabulary([*observed, *(Predicate(a.predicate, len(a.terms), DERIVED) for _, a in sorted(heads.items()))])


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
