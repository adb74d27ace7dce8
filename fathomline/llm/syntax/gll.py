"""Generalised LL recognition with a graph-structured stack, over grammars with regular right-hand sides.

A rule becomes a minimal automaton over terminals and rule names; its states are the grammar slots. A descriptor is (state,
stack node, position); a stack node is (rule, position), shared by all callers, so dialects whose start rules run together
share every common part of the stack. One token of lookahead (FIRST and FOLLOW) prunes choices: where one is left the
parser just goes on, descriptors are only queued where several remain.

Rules marked `!` are put into the rules that name them before the automata are made. What alternatives have in common is
then left-factored by the subset construction itself, and most tokens are plain shifts within one automaton rather than
calls through a chain of rules.

Grammar text: `name : alternatives ;` or `name ! : alternatives ;` with 'literals', CLASS tokens, rule names, ( ) ? * + |.
ASI stands for nothing at all where the scanner saw a line end before the next token, or the next token is '}' or the end.
"""

from __future__ import annotations

import re

END = "END"
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)+')|([A-Za-z_][A-Za-z_0-9]*)|([!:;()?*+|]))")


class Grammar:
    """Compiled automata: `table[state][kind]` holds the actions, `shifts[state][kind]` the next state where a shift is the only one."""

    def __init__(self, text: str, soft: dict[str, str] | None = None, extra_kinds: tuple[str, ...] = ()):
        self.soft = soft or {}
        rules = self._read(text)
        self.names = {n: i for i, n in enumerate(rules)}
        kinds: dict[str, int] = {END: 0}
        for n in extra_kinds:
            kinds.setdefault(n, len(kinds))
        for tree in rules.values():
            self._collect(tree, kinds)
        for k, base in self.soft.items():
            kinds.setdefault(k, len(kinds))
            kinds.setdefault(base, len(kinds))
        kinds.pop("ASI", None)
        self.kinds = {k: i for i, k in enumerate(kinds)}
        if len(self.kinds) > 250:
            raise ValueError("too many token kinds")
        self._build(rules)

    # -- reading

    @staticmethod
    def _read(text: str) -> dict[str, tuple]:
        toks, at = [], 0
        text = re.sub(r"(?m)^#.*$", "", text).strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"bad grammar near {text[at : at + 40]!r}")
            toks.append(m.group(m.lastindex))
            at = m.end()
        pos, rules, inline = 0, {}, set()

        def alt() -> tuple:
            nonlocal pos
            opts = [seq()]
            while toks[pos] == "|":
                pos += 1
                opts.append(seq())
            return ("alt", opts)

        def seq() -> tuple:
            nonlocal pos
            items = []
            while toks[pos] not in ("|", ")", ";"):
                t = toks[pos]
                pos += 1
                if t == "(":
                    item = alt()
                    pos += 1
                else:
                    item = ("sym", t)
                while toks[pos] in ("?", "*", "+"):
                    item = ({"?": "opt", "*": "star", "+": "plus"}[toks[pos]], item)
                    pos += 1
                items.append(item)
            return ("seq", items)

        while pos < len(toks):
            name = toks[pos]
            pos += 1
            if toks[pos] == "!":
                inline.add(name)
                pos += 1
            if toks[pos] != ":":
                raise ValueError(f"no ':' after {name}")
            pos += 1
            body = alt()
            if name in rules:
                raise ValueError(f"rule {name} twice")
            rules[name] = body
            pos += 1

        def put(tree: tuple, inside: tuple[str, ...]) -> tuple:
            kind, body = tree
            if kind == "sym":
                if body not in inline:
                    return tree
                if body in inside:
                    raise ValueError(f"rule {body} calls itself and cannot be put in place")
                return put(rules[body], (*inside, body))
            return (kind, [put(x, inside) for x in body] if isinstance(body, list) else put(body, inside))

        return {n: put(t, ()) for n, t in rules.items() if n not in inline}

    def _terminal(self, sym: str) -> str | None:
        return sym[1:-1] if sym[0] == "'" else sym if sym.isupper() and len(sym) > 1 else None

    def _collect(self, tree: tuple, kinds: dict[str, int]) -> None:
        if tree[0] == "sym":
            t = self._terminal(tree[1])
            if t:
                kinds.setdefault(t, len(kinds))
        else:
            for x in tree[1] if isinstance(tree[1], list) else [tree[1]]:
                self._collect(x, kinds)

    # -- automata

    @staticmethod
    def _automaton(tree: tuple) -> tuple[list[dict[str, int]], list[bool]]:
        """(moves, final) of the minimal automaton of a right-hand side; state 0 is the start."""
        eps: list[list[int]] = []
        arcs: list[list[tuple[str, int]]] = []

        def new() -> int:
            eps.append([])
            arcs.append([])
            return len(eps) - 1

        def make(tree: tuple, a: int) -> int:
            kind, body = tree
            if kind == "sym":
                b = new()
                arcs[a].append((body, b))
                return b
            if kind == "seq":
                for x in body:
                    a = make(x, a)
                return a
            out = new()
            if kind == "alt":
                for x in body:
                    own = new()
                    eps[a].append(own)
                    eps[make(x, own)].append(out)
                return out
            loop = new()
            eps[a].append(loop)
            end = make(body, loop)
            if kind != "opt":
                eps[end].append(loop)
            eps[end].append(out)
            if kind != "plus":
                eps[loop].append(out)
            return out

        def closure(s: set[int]) -> frozenset[int]:
            todo, got = list(s), set(s)
            while todo:
                for y in eps[todo.pop()]:
                    if y not in got:
                        got.add(y)
                        todo.append(y)
            return frozenset(y for y in got if arcs[y] or y == f)

        s = new()
        f = -1
        f = make(tree, s)
        begin = closure({s})
        ids, moves, final, todo = {begin: 0}, [{}], [f in begin], [begin]
        while todo:
            here = todo.pop()
            by: dict[str, set[int]] = {}
            for x in here:
                for sym, y in arcs[x]:
                    by.setdefault(sym, set()).add(y)
            for sym, ys in by.items():
                to = closure(ys)
                if to not in ids:
                    ids[to] = len(moves)
                    moves.append({})
                    final.append(f in to)
                    todo.append(to)
                moves[ids[here]][sym] = ids[to]
        group = [int(x) for x in final]
        while True:  # states that no text tells apart are one state
            seen: dict[tuple, int] = {}
            fresh = [seen.setdefault((group[i], *sorted((sym, group[to]) for sym, to in m.items())), len(seen)) for i, m in enumerate(moves)]
            if len(seen) == len(set(group)):
                break
            group = fresh
        group = fresh  # state 0 comes first, so its group is 0
        small: list[dict[str, int]] = [{} for _ in range(len(seen))]
        ends = [False] * len(seen)
        for i, m in enumerate(moves):
            small[group[i]] = {sym: group[to] for sym, to in m.items()}
            ends[group[i]] = final[i]
        return small, ends

    def _build(self, rules: dict) -> None:
        moves: list[dict[str, int]] = []
        final: list[bool] = []
        owner: list[int] = []
        self.start: list[int] = []
        for name, tree in rules.items():
            m, f = self._automaton(tree)
            base = len(moves)
            self.start.append(base)
            moves += [{sym: to + base for sym, to in x.items()} for x in m]
            final += f
            owner += [self.names[name]] * len(m)
        n, width = len(moves), len(self.kinds)
        every = (1 << width) - 1
        accept = dict.fromkeys(self.kinds, 0)
        for k, i in self.kinds.items():
            accept[k] |= 1 << i
            if k in self.soft:
                accept[self.soft[k]] |= 1 << i
        accept["ASI"] = every
        steps: list[list[tuple[int, int, int]]] = []  # of each state: (kinds of a terminal or 0, rule or -1, next)
        for m in moves:
            row = []
            for sym, to in m.items():
                t = self._terminal(sym)
                if not t and sym not in self.names:
                    raise ValueError(f"no rule {sym}")
                row.append((accept[t], -1, to) if t else (0, self.names[sym], to))
            steps.append(row)
        first = [0] * n
        null = list(final)
        change = True
        while change:
            change = False
            for s in range(n - 1, -1, -1):
                f, nl = first[s], null[s]
                for t, rule, to in steps[s]:
                    f |= t
                    if rule >= 0:
                        r = self.start[rule]
                        f |= first[r]
                        if null[r]:
                            f |= first[to]
                            nl = nl or null[to]
                if f != first[s] or nl != null[s]:
                    first[s], null[s], change = f, nl, True
        follow = [int(name.startswith("start")) for name in self.names]
        change = True
        while change:
            change = False
            for s in range(n):
                for _, rule, to in steps[s]:
                    if rule >= 0:
                        add = first[to] | (follow[owner[s]] if null[to] else 0)
                        if add & ~follow[rule]:
                            follow[rule] |= add
                            change = True
        # actions: (0, next) shift; (1, rule, next) call; (2,) return; (3, next) line end
        self.table: list[list[tuple | None]] = []
        self.shifts: list[list[int]] = []
        cached: dict[int, list[int]] = {}

        def members(mask: int) -> list[int]:
            if mask not in cached:
                cached[mask] = [a for a in range(width) if mask >> a & 1]
            return cached[mask]

        for s in range(n):
            row: list[list[tuple] | None] = [None] * width

            def add(mask: int, act: tuple) -> None:
                for a in members(mask):
                    if row[a] is None:
                        row[a] = [act]
                    else:
                        row[a].append(act)

            for sym, (t, rule, to) in zip(moves[s], steps[s]):
                if sym == "ASI":
                    add(every, (3, to))
                elif rule < 0:
                    add(t, (0, to))
                else:
                    r = self.start[rule]
                    add(first[r] | ((first[to] | (follow[owner[s]] if null[to] else 0)) if null[r] else 0), (1, rule, to))
            if final[s]:
                add(follow[owner[s]], (2,))
            self.table.append([None if x is None else tuple(x) for x in row])
            self.shifts.append([x[0][1] if x is not None and len(x) == 1 and x[0][0] == 0 else -1 for x in row])

    # -- running

    def accepts(self, ids: bytes, starts: list[str], breaks: bytes | None = None) -> tuple[str | None, int]:
        """(start rule that derives all of `ids`, or None; furthest token looked at). `ids` ends with kind 0.

        `breaks[i]` is 1 where a line end precedes token i. All start rules run on one stack; the first to succeed ends it.
        The answer depends on the arguments alone: nothing is kept from one text to the next.
        """
        table, shifts, begin = self.table, self.shifts, self.start
        last = len(ids) - 1
        width = last + 1
        close = self.kinds.get("}", -1)
        nodes: dict[int, list] = {}  # [edges (state, node), positions returned, number]
        todo: list[tuple[tuple, list, int]] = []  # descriptors: (action, node, position)
        seen: set[tuple[int, int, int]] = set()  # returns made: (state, number of the node, position)
        wanted: dict[int, str] = {}
        far = 0
        for name in reversed(starts):
            i = self.names[name]
            nodes[i * width] = node = [[], [], i * width]
            wanted[i * width] = name
            todo += [(a, node, 0) for a in table[begin[i]][ids[0]] or ()]
        while todo:
            act, node, pos = todo.pop()
            while True:
                op = act[0]
                if op == 0:  # shift
                    state = act[1]
                    pos += 1
                elif op == 1:  # call
                    i = act[1]
                    key = i * width + pos
                    kid = nodes.get(key)
                    if kid is not None:
                        kid[0].append((act[2], node))
                        for p in kid[1]:
                            mark = (act[2], node[2], p)
                            if mark not in seen:
                                seen.add(mark)
                                todo += [(a, node, p) for a in table[act[2]][ids[p]] or ()]
                        break
                    nodes[key] = node = [[(act[2], node)], [], key]
                    state = begin[i]
                elif op == 2:  # return
                    if pos in node[1]:
                        break
                    node[1].append(pos)
                    if node[2] in wanted:
                        if pos == last:
                            return wanted[node[2]], pos
                        break
                    edges = node[0]
                    if len(edges) > 1:
                        for to, up in edges[1:]:
                            mark = (to, up[2], pos)
                            if mark not in seen:
                                seen.add(mark)
                                todo += [(a, up, pos) for a in table[to][ids[pos]] or ()]
                    state, node = edges[0]
                    mark = (state, node[2], pos)
                    if mark in seen:
                        break
                    seen.add(mark)
                elif ids[pos] == close or pos == last or (breaks is not None and breaks[pos]):  # line end
                    state = act[1]
                else:
                    break
                to = shifts[state][ids[pos]]
                while to >= 0:
                    pos += 1
                    state = to
                    to = shifts[state][ids[pos]]
                if pos > far:
                    far = pos
                acts = table[state][ids[pos]]
                if acts is None:
                    break
                if len(acts) > 1:
                    todo += [(a, node, pos) for a in acts[:0:-1]]
                act = acts[0]
        return None, far
