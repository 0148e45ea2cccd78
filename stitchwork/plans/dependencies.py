"""Algebra of functional dependencies over attribute sets, and normalisation plans. Metadata only: sets of names, in sorted order.

A set of dependencies is a dict from determinant (frozenset) to dependants (frozenset).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import combinations

Attrs = frozenset
Fds = dict[Attrs, Attrs]


def make(pairs: Iterable[tuple[Iterable[str], Iterable[str]]]) -> Fds:
    """Dependencies with equal determinants merged."""
    out: Fds = {}
    for det, dep in pairs:
        out[frozenset(det)] = out.get(frozenset(det), frozenset()) | frozenset(dep)
    return out


def in_order(fds: Fds) -> list[tuple[Attrs, Attrs]]:
    return sorted(fds.items(), key=lambda f: (len(f[0]), sorted(f[0]), sorted(f[1])))


def split(fds: Fds) -> list[tuple[Attrs, str]]:
    return [(det, a) for det, dep in in_order(fds) for a in sorted(dep)]


def closure(attrs: Iterable[str], fds: Fds) -> Attrs:
    """G01."""
    known, changed = set(attrs), True
    while changed:
        changed = False
        for det, dep in fds.items():
            if det <= known and not dep <= known:
                known |= dep
                changed = True
    return frozenset(known)


def derivation(attrs: Iterable[str], target: str, fds: Fds) -> list[tuple[Attrs, Attrs]]:
    """The dependencies, in order of use, that lead from the attributes to the target; empty if none do."""
    known, by = set(attrs), {}
    changed = True
    while changed and target not in known:
        changed = False
        for det, dep in in_order(fds):
            if det <= known and not dep <= known:
                by.update({a: (det, dep) for a in dep - known})
                known |= dep
                changed = True
    out, want = [], [target] if target in known else []
    while want:
        if (used := by.get(want.pop())) and used not in out:
            out.insert(0, used)
            want += sorted(used[0])
    return out


def null_free_closure(attrs: Iterable[str], fds: Fds, null_free: Attrs) -> Attrs:
    """Steps beyond the start only through determinants without nulls; then one direct step from the start."""
    start = frozenset(attrs)
    known, changed = set(start), True
    while changed:
        changed = False
        for det, dep in fds.items():
            if det <= known and det <= (null_free | start) and det - start <= null_free and not dep <= known:
                known |= dep
                changed = True
    return frozenset(known).union(*(dep for det, dep in fds.items() if det <= start))


def strong_weak_closure(attrs: Iterable[str], strong: Fds, weak: Fds) -> Attrs:
    """Strong dependencies to the fixpoint, then one step of weak ones."""
    known = closure(attrs, strong)
    return known.union(*(dep for det, dep in weak.items() if det <= known))


def provenance_closure(attrs: Iterable[str], fds: Fds, always_strong: Callable[[Attrs, str], bool]) -> Attrs:
    """Dependencies that always hold chain; others apply only to the start itself."""
    start, known, changed = frozenset(attrs), set(attrs), True
    while changed:
        changed = False
        for det, a in split(fds):
            if a not in known and det <= known and (det <= start or always_strong(det, a)):
                known.add(a)
                changed = True
    return frozenset(known)


def weak_closure(attrs: Iterable[str], fds: Fds, together: Callable[[Attrs], bool]) -> Attrs:
    """A dependency applies if the start and its determinant stand together in some source."""
    start, known, changed = frozenset(attrs), set(attrs), True
    while changed:
        changed = False
        for det, dep in fds.items():
            if det <= known and not dep <= known and together(start | det):
                known |= dep
                changed = True
    return frozenset(known)


#: How a closure is taken: closure itself, or one of the others with their further arguments bound.
Closure = Callable[[Iterable[str], Fds], Attrs]


def is_super_key(attrs: Iterable[str], schema: Attrs, fds: Fds, close: Closure = closure) -> bool:
    return close(attrs, fds) >= schema


def minimal_key(attrs: Iterable[str], schema: Attrs, fds: Fds, close: Closure = closure) -> Attrs:
    key = set(attrs)
    for a in sorted(attrs):
        if is_super_key(key - {a}, schema, fds, close):
            key.discard(a)
    return frozenset(key)


def candidate_keys(schema: Iterable[str], fds: Fds, excluded: Iterable[str] = (), close: Closure = closure) -> list[Attrs]:
    """All minimal keys, each found from another one and a dependency. With excluded columns, keys without them."""
    schema, excluded = frozenset(schema), frozenset(excluded)
    if not is_super_key(schema - excluded, schema, fds, close):
        return []
    found = [minimal_key(schema - excluded, schema, fds, close)]
    for key in found:
        for det, dep in in_order(fds):
            new = det | (key - dep)
            if not new & excluded and not any(k <= new for k in found) and is_super_key(new, schema, fds, close):
                found.append(minimal_key(new, schema, fds, close))
    return sorted(found, key=lambda k: (len(k), sorted(k)))


def reduce_left(det: Attrs, dep: Attrs, fds: Fds, close: Closure = closure) -> Attrs:
    """The determinant without attributes that the others imply."""
    for a in sorted(det):
        if dep <= close(det - {a}, fds):
            det = det - {a}
    return det


def canonical_cover(fds: Fds, focus: frozenset = frozenset()) -> Fds:
    """Reduced on both sides, without empty dependants, equal determinants merged; dependencies with a focus attribute come last."""
    singles = [(reduce_left(det, frozenset([a]), fds), a) for det, a in split(fds) if a not in det]
    singles = sorted(dict.fromkeys(singles), key=lambda f: (bool((f[0] | {f[1]}) & focus), len(f[0]), sorted(f[0]), f[1]))
    kept = list(singles)
    for f in reversed(singles):
        rest = [g for g in kept if g != f]
        if f[1] in closure(f[0], make((d, [a]) for d, a in rest)):
            kept = rest
    return make((det, [a]) for det, a in kept)


def minimised(fds: Fds, close: Closure = closure) -> Fds:
    return make((reduce_left(det, frozenset([a]), fds, close), [a]) for det, a in split(fds) if a not in det)


def all_closures(fds: Fds, close: Closure = closure) -> Fds:
    """G10."""
    return {det: close(det, fds) for det in fds}


def implies(left: Fds, right: Fds, close: Closure = closure) -> bool:
    return all(dep <= close(det, left) for det, dep in right.items())


def equivalent(left: Fds, right: Fds, close: Closure = closure) -> bool:
    return implies(left, right, close) and implies(right, left, close)


def not_in(left: Fds, right: Fds) -> Fds:
    """What of the left the right does not imply."""
    return make((det, dep - closure(det, right)) for det, dep in left.items() if not dep <= closure(det, right))


def generalisations(det: Attrs, dep: Attrs) -> list[tuple[Attrs, Attrs]]:
    return [(det - {a}, dep) for a in sorted(det)]


def specialisations(det: Attrs, dep: Attrs, schema: Attrs) -> list[tuple[Attrs, Attrs]]:
    return [(det | {a}, dep) for a in sorted(schema - det - dep)]


def has_generalisation(det: Attrs, a: str, fds: Fds) -> bool:
    return any(d < det and a in dep for d, dep in fds.items())


class DependencySet:
    """Dependencies that can be withdrawn; what withdrawing one breaks is withdrawn, or specialised, too."""

    def __init__(self, fds: Fds, schema: Iterable[str]):
        self.fds, self.schema = dict(fds), frozenset(schema)

    def invalidate(self, det: Attrs, a: str, specialise: bool = False) -> None:
        """Without det -> a, and without any dependency that still implies it; optionally with its specialisations instead."""
        for d, dep in list(self.fds.items()):
            if d <= det and a in dep:
                self._drop(d, a)
        if specialise:
            for d, dep in specialisations(det, frozenset([a]), self.schema):
                if not has_generalisation(d, a, self.fds):
                    self.fds[d] = self.fds.get(d, frozenset()) | dep

    def _drop(self, det: Attrs, a: str) -> None:
        self.fds[det] -= {a}
        if not self.fds[det]:
            del self.fds[det]

    def propagate(self, larger: Attrs, smaller: Attrs) -> None:
        """What the smaller determinant implies, for the larger one too."""
        self.fds[larger] = self.fds.get(larger, frozenset()) | self.fds.get(smaller, frozenset()) - larger

    def consistent(self) -> bool:
        return all(det | dep <= self.schema and dep for det, dep in self.fds.items())


def projected(fds: Fds, columns: Iterable[str]) -> Fds:
    """Determinants inside the columns, with their dependants there."""
    columns = frozenset(columns)
    return {det: dep & columns for det, dep in fds.items() if det <= columns and dep & columns}


def with_foreign_key(fds: Fds, fk: str = "FK") -> Fds:
    """Closures whose determinant has the foreign key or is empty, minimised."""
    return minimised({det: closure(det, fds) - det for det in fds if fk in det or not det} | {})


def binary_dependencies(columns: Iterable[str], fk: str = "FK") -> Fds:
    """G15."""
    return {frozenset([fk]): frozenset(columns) - {fk}}


def propagate_over(fds: Fds, together: Callable[[Attrs], bool], fixed: frozenset = frozenset()) -> Fds:
    """X -> Y also for larger determinants X' whose other attributes stand together with Y in a source; never over fixed ones."""
    out = dict(fds)
    for det, dep in in_order(fds):
        for larger in sorted(fds, key=sorted):
            more = larger - det
            if det < larger and more and not more & fixed:
                gain = frozenset(a for a in dep - larger if together(more | {a}))
                if gain:
                    out[larger] |= gain
    return out


def stitched_dependencies(sources: dict[str, tuple[int, Attrs, Fds]], least: float = 0.05) -> Fds:
    """Dependencies of source tables (size, columns, dependencies) carried over to their universal relation. By size of determinant,
    one is taken if its source is large enough among those with the dependant, and given up again if a source that is large enough
    among those with both sides does not have it."""
    sizes = {t: n for t, (n, _, _) in sources.items()}
    largest = lambda need: max((sizes[t] for t, (_, cols, _) in sources.items() if need <= cols), default=0)
    found: Fds = {}
    candidates = sorted({(det, a) for _, _, fds in sources.values() for det, a in split(fds)}, key=lambda f: (len(f[0]), sorted(f[0]), f[1]))
    for det, a in candidates:
        if has_generalisation(det, a, found):
            continue
        holds = [t for t, (_, cols, fds) in sources.items() if det | {a} <= cols and a in closure(det, fds)]
        breaks = [t for t, (_, cols, fds) in sources.items() if det | {a} <= cols and t not in holds]
        big = lambda ts, need: any(sizes[t] >= least * largest(need) for t in ts)
        if big(holds, frozenset([a])) and not big(breaks, det | {a}):
            found[det] = found.get(det, frozenset()) | {a}
    return found


def violation_score(det: Attrs, dep: Attrs, schema: list[str], sources: dict[str, int], types: dict[str, str]) -> float:
    """Mean of what speaks for a determinant: no numeric attribute, few attributes, attributes that most sources have, and
    determinant and dependants kept apart from disambiguations of each other."""
    n = max(sources.values(), default=1)
    kind = sum(types.get(a, "string") != "numeric" for a in det) / max(1, len(det))
    length = 1 / max(1, len(det))
    spread = min((sources.get(a, 0) / n for a in det), default=0.0)
    names = [a.removeprefix("Disambiguation of ") for a in det]
    apart = float(not any(n in dep for n in names if n not in det))
    return (kind + length + spread + apart) / 4


Relation = tuple[Attrs, Attrs]  # attributes, key


def second_normal_form(schema: Iterable[str], fds: Fds) -> list[Relation]:
    """What depends on part of a key moves to a relation of that part."""
    schema = frozenset(schema)
    keys = candidate_keys(schema, fds)
    prime, key = frozenset().union(*keys), keys[0]
    out, rest = [], schema
    for n in range(1, len(key)):
        for part in map(frozenset, combinations(sorted(key), n)):
            dep = (closure(part, fds) - part - prime) & rest
            if dep:
                out.append((part | dep, part))
                rest -= dep
    return [*out, (rest, key)]


def third_normal_form(schema: Iterable[str], fds: Fds) -> list[Relation]:
    """A relation for each group of equivalent determinants of the canonical cover, and one for a key if none has one."""
    schema, cover = frozenset(schema), canonical_cover(fds)
    groups: dict[Attrs, list[tuple[Attrs, Attrs]]] = {}
    for det, dep in in_order(cover):
        groups.setdefault(closure(det, cover), []).append((det, dep))
    out = [(frozenset().union(*(d | e for d, e in g)), g[0][0]) for g in groups.values()]
    out = [r for r in out if not any(r[0] < o[0] for o in out)]
    keys = candidate_keys(schema, cover)
    if not any(k <= attrs for k in keys for attrs, _ in out):
        out.append((keys[0], keys[0]))
    return out


def boyce_codd_normal_form(schema: Iterable[str], fds: Fds, fk: str | None = None, score: Callable[[Attrs, Attrs], float] | None = None) -> list[Relation]:
    """As long as a determinant is no key, what it determines moves to a relation of its own, best-scored determinant first. With fk,
    only determinants that hold it count, which must be a part of a key, and key attributes stay. Attributes that need no determinant stay."""
    schema = frozenset(schema)
    fixed = closure((), fds)
    todo, out = [schema], []
    while todo:
        attrs = todo.pop()
        own = {det: (closure(det, fds) - det - fixed) & attrs for det in fds if det and det <= attrs}
        local = {det: dep for det, dep in own.items() if dep}
        keys = candidate_keys(attrs, local)
        prime = frozenset().union(*keys) if fk else frozenset()
        bad = [(det, dep - prime) for det, dep in in_order(local) if not is_super_key(det, attrs - fixed, local) and dep - prime]
        if fk:
            bad = [(det, dep) for det, dep in bad if fk in det and any(det < k for k in keys)]
        if not bad:
            out.append((attrs, keys[0]))
            continue
        det, dep = max(bad, key=lambda v: score(*v)) if score else bad[0]
        todo.append(attrs - dep)
        todo.append(det | dep)
    return sorted(out, key=lambda r: (sorted(r[1]), sorted(r[0])))


def key_by_dependencies(schema: Iterable[str], fds: Fds) -> Attrs | None:
    """The largest determinant that determines all columns."""
    keys = [det for det in fds if is_super_key(det, frozenset(schema), fds)]
    return max(keys, key=lambda k: (len(k), sorted(k)), default=None)


def approximate_keys(keys: Iterable[Attrs], uniqueness: Callable[[Attrs], float], least: float) -> set[Attrs]:
    """Candidate keys made smaller as long as they stay unique enough."""
    out, todo = set(), [frozenset(k) for k in keys]
    while todo:
        key = todo.pop()
        smaller = [key - {a} for a in sorted(key) if len(key) > 1 and uniqueness(key - {a}) >= least]
        todo += smaller
        if not smaller:
            out.add(key)
    return out


def together(sources: dict[str, Attrs]) -> Callable[[Attrs], bool]:
    """Whether some source has all these columns."""
    return lambda columns: any(columns <= s for s in sources.values())
