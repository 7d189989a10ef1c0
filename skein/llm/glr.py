"""A table-driven parser for any context-free grammar: LR(0) states built when first met, SLR(1) look-ahead, and a
graph-structured stack where an entry of the table holds several actions.

Grammar files hold rules `name : alternatives ;` over 'literals', TOKEN names and rule names, with [optional], {repeated}
and (grouped) parts, and `#` comments. `%if flag` ... `%end` includes rules only for grammars built with that flag; a rule
given again adds alternatives. `%any` stands for every terminal but brackets, `%start name` names the start rule.

While the stack has one head and its table entry one action, parsing is that of an ordinary LR parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

END = "$end"
BRACKETS = {"(", ")", "[", "]", "{", "}"}
_LEX = re.compile(r"\s+|#[^\n]*|(?P<word>%?[A-Za-z_]\w*)|'(?P<lit>[^'\n]+)'|(?P<op>[:;|\[\]{}()])")


class Grammar:
    """Rules, and the table that grows as states are met."""

    def __init__(self, text: str, flags: Iterable[str] = ()):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.start = ""
        self._count = 0
        self._read(text, set(flags))
        heads = set(self.rules)
        self.terminals = {s for alts in self.rules.values() for a in alts for s in a if s not in heads and s != "%any"} | {END}
        if any("%any" in a for alts in self.rules.values() for a in alts):
            self.rules["%any"] = [(t,) for t in sorted(self.terminals - BRACKETS - {END})]
        self.prods: list[tuple[str, tuple[str, ...]]] = [("$start", (self.start,))]
        self.of: dict[str, list[int]] = {}
        for head, alts in self.rules.items():
            for a in dict.fromkeys(alts):
                self.of.setdefault(head, []).append(len(self.prods))
                self.prods.append((head, a))
        self._follow()
        self.states: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.actions: list[dict | None] = []
        self.gotos: list[dict] = []
        self._state(frozenset({(0, 0)}))

    def _read(self, text: str, flags: set[str]) -> None:
        toks, pos = [], 0
        while pos < len(text):
            m = _LEX.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos : pos + 30]!r}")
            pos = m.end()
            if m["word"] or m["lit"] or m["op"]:
                toks.append((m.lastgroup, m[m.lastgroup]))
        i, skip = 0, False
        while i < len(toks):
            kind, word = toks[i]
            if word == "%start":
                self.start = f"<{toks[i + 1][1]}>"
                i += 2
            elif word == "%if":
                skip = toks[i + 1][1] not in flags
                i += 2
            elif word == "%end":
                skip, i = False, i + 1
            else:
                i, alts = self._alternatives(toks, i + 2, keep=not skip)
                if not skip:
                    self.rules.setdefault(f"<{word}>", []).extend(alts)
                i += 1

    def _new(self, alts: list[tuple[str, ...]]) -> str:
        self._count += 1
        name = f"${self._count}"
        self.rules[name] = alts
        return name

    def _alternatives(self, toks: list, i: int, keep: bool) -> tuple[int, list[tuple[str, ...]]]:
        alts: list[tuple[str, ...]] = []
        seq: list[str] = []
        while True:
            kind, x = toks[i]
            if kind == "op" and x in ";|)]}":
                alts.append(tuple(seq))
                seq = []
                if x != "|":
                    return i, alts
            elif kind == "op":
                i, inner = self._alternatives(toks, i + 1, keep)
                if keep:
                    if x == "(":
                        seq.append(self._new(inner))
                    elif x == "[":
                        seq.append(self._new([(), *inner]))
                    else:
                        self._count += 1
                        name = f"${self._count}"
                        self.rules[name] = [(), *((name, *a) for a in inner)]
                        seq.append(name)
            else:
                seq.append(x if kind == "lit" or x.isupper() or x == "%any" else f"<{x}>")
            i += 1

    def _follow(self) -> None:
        first: dict[str, set[str]] = {h: set() for h in self.of}
        self.nullable: set[str] = set()
        changed = True
        while changed:
            changed = False
            for head, rhs in self.prods[1:]:
                f, n = first[head], len(first[head])
                for s in rhs:
                    f |= first[s] if s in first else {s}
                    if s not in self.nullable:
                        break
                else:
                    if head not in self.nullable:
                        self.nullable.add(head)
                        changed = True
                changed |= len(f) != n
        follow: dict[str, set[str]] = {h: set() for h in self.of}
        follow["$start"] = {END}
        changed = True
        while changed:
            changed = False
            for head, rhs in self.prods:
                tail = set(follow[head])
                for s in reversed(rhs):
                    if s in first:
                        n = len(follow[s])
                        follow[s] |= tail
                        changed |= len(follow[s]) != n
                        tail = tail | first[s] if s in self.nullable else set(first[s])
                    else:
                        tail = {s}
        self.follow = follow

    def _state(self, kernel: frozenset) -> int:
        if kernel not in self.index:
            self.index[kernel] = len(self.states)
            self.states.append(kernel)
            self.actions.append(None)
            self.gotos.append({})
        return self.index[kernel]

    def table(self, s: int) -> dict:
        """Terminal -> (state to shift to or -1, productions to reduce as (head, length, number))."""
        if self.actions[s] is not None:
            return self.actions[s]
        items, todo = set(self.states[s]), list(self.states[s])
        while todo:
            p, dot = todo.pop()
            rhs = self.prods[p][1]
            if dot < len(rhs):
                for q in self.of.get(rhs[dot], ()):
                    if (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        moves: dict[str, set] = {}
        reduces: dict[str, list] = {}
        for p, dot in items:
            head, rhs = self.prods[p]
            if dot < len(rhs):
                moves.setdefault(rhs[dot], set()).add((p, dot + 1))
            else:
                for t in self.follow[head]:
                    reduces.setdefault(t, []).append((head, len(rhs), p))
        act: dict[str, tuple[int, tuple]] = {t: (-1, tuple(r)) for t, r in reduces.items()}
        for x, kernel in moves.items():
            to = self._state(frozenset(kernel))
            if x in self.of:
                self.gotos[s][x] = to
            else:
                act[x] = (to, act[x][1] if x in act else ())
        self.actions[s] = act
        return act


class Parser:
    """Recognises token streams.

    A configuration is the set of stack heads after some tokens. Stack nodes are interned (one node per state and set of
    nodes below it), so equal stacks are one object wherever they come up, and a configuration remembers what each token
    leads to. Sources repeat constructs far more than they invent them; most tokens are then one look-up. The memory is
    dropped when it holds KEEP configurations.
    """

    KEEP = 200_000

    def __init__(self, grammar: Grammar, inserted: str | None = None):
        self.g = grammar
        #: A terminal that may be put in before a token that does not fit (the automatic semicolon), where allowed.
        self.inserted = inserted if inserted in grammar.terminals else None
        self._forget()

    def _forget(self) -> None:
        self._uid = 0
        self._nodes: dict[tuple, _Node] = {}
        self._configs: dict[tuple, _Config] = {}
        self.first = self._config([self._node(0, ())])

    def parse(self, kinds: list[str], may_insert: list[bool] | None = None) -> int:
        """The index of the first token that no parse of the tokens before it can go on with; -1 if all is well."""
        if len(self._configs) > self.KEEP:
            self._forget()
        at = self.first
        for i, kind in enumerate([*kinds, END]):
            after = at.next[kind] if kind in at.next else self._advance(at, kind)
            if after is None and self.inserted and (may_insert is None or may_insert[i]):
                after = at.next[self.inserted] if self.inserted in at.next else self._advance(at, self.inserted)
                if after is not None:
                    after = after.next[kind] if kind in after.next else self._advance(after, kind)
            if after is None:
                return i
            at = after
        return -1

    def _node(self, state: int, links: tuple[_Node, ...]) -> _Node:
        key = (state, *sorted(x.uid for x in links))
        if key not in self._nodes:
            self._uid += 1
            self._nodes[key] = _Node(state, links, self._uid)
        return self._nodes[key]

    def _config(self, heads: list[_Node]) -> _Config:
        key = tuple(sorted(x.uid for x in heads))
        if key not in self._configs:
            self._configs[key] = _Config(heads)
        return self._configs[key]

    def _advance(self, at: _Config, kind: str) -> _Config | None:
        at.next[kind] = after = self._step(at.heads, kind)
        return after

    def _step(self, heads: list[_Node], kind: str) -> _Config | None:
        table, gotos = self.g.table, self.g.gotos
        if len(heads) == 1:
            node = heads[0]
            while True:
                act = table(node.state).get(kind)
                if act is None:
                    return None
                to, reds = act
                if to >= 0 and not reds:
                    return self._config([self._node(to, (node,))])
                if to >= 0 or len(reds) > 1:
                    break
                head, n, p = reds[0]
                if p == 0:
                    return _Config([])
                base = node
                for _ in range(n):
                    if len(base.links) > 1:
                        break
                    base = base.links[0]
                else:
                    table(base.state)
                    node = self._node(gotos[base.state][head], (base,))
                    continue
                break
            heads = [node]
        return self._branch(heads, kind)

    def _branch(self, heads: list[_Node], kind: str) -> _Config | None:
        """All reductions under `kind` over the graph, then the shifts. Reductions run again when a node of this level
        gets another link, over the paths that use it."""
        table, gotos = self.g.table, self.g.gotos
        level = {n.state: _Node(n.state, list(n.links), -1) for n in heads}
        shifts: dict[int, list] = {}
        done = False
        todo = list(level.values())
        seen: set = set()
        while todo:
            node = todo.pop()
            act = table(node.state).get(kind)
            if act is None:
                continue
            for head, n, p in act[1]:
                if p == 0:
                    done = True
                    continue
                bases = {id(node): node}
                for _ in range(n):
                    bases = {id(b): b for x in bases.values() for b in x.links}
                for base in bases.values():
                    if (node.state, p, id(base)) in seen:
                        continue
                    seen.add((node.state, p, id(base)))
                    table(base.state)
                    to = gotos[base.state][head]
                    old = level.get(to)
                    if old is None:
                        level[to] = new = _Node(to, [base], -1)
                        todo.append(new)
                    elif all(b is not base for b in old.links):
                        old.links.append(base)
                        todo.extend(level.values())
        if done:
            return _Config([])
        for node in level.values():
            act = table(node.state).get(kind)
            if act and act[0] >= 0:
                shifts.setdefault(act[0], []).append(node)
        if not shifts:
            return None
        kept: dict[int, _Node | None] = {}

        def intern(x: _Node) -> _Node:
            if x.uid >= 0:
                return x
            if id(x) in kept:
                if kept[id(x)] is None:
                    raise RecursionError  # a loop of empty reductions: such nodes stay as they are
                return kept[id(x)]
            kept[id(x)] = None
            kept[id(x)] = out = self._node(x.state, tuple(intern(b) for b in x.links))
            return out

        try:
            return self._config([self._node(s, tuple(intern(n) for n in nodes)) for s, nodes in shifts.items()])
        except RecursionError:
            self._uid += 1 + len(level)
            for k, n in enumerate(level.values()):
                n.uid = self._uid - k
            return self._config([self._node(s, tuple(nodes)) for s, nodes in shifts.items()])


class _Node:
    __slots__ = ("links", "state", "uid")

    def __init__(self, state: int, links: tuple | list, uid: int):
        self.state, self.links, self.uid = state, links, uid


class _Config:
    __slots__ = ("heads", "next")

    def __init__(self, heads: list[_Node]):
        self.heads, self.next = heads, {}


def load(name: str, flags: Iterable[str] = ()) -> Grammar:
    """A bundled grammar."""
    return Grammar((Path(__file__).parent / "grammars" / f"{name}.g").read_text(), flags)
