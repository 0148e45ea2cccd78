"""The algebra of dependencies, on small schemata and against brute force."""

import random
from itertools import combinations

from stitchwork.plans import dependencies as d

F = frozenset


def subsets(attrs):
    return [F(c) for n in range(len(attrs) + 1) for c in combinations(sorted(attrs), n)]


def random_fds(r, attrs):
    pick = lambda n: r.sample(sorted(attrs), n)
    return d.make((pick(r.randint(1, 2)), pick(r.randint(1, 2))) for _ in range(r.randint(1, 6)))


def test_closure_and_derivation():
    fds = d.make([("a", "b"), ("b", "c"), ("cd", "e")])
    assert d.closure("a", fds) == F("abc") and d.closure("ad", fds) == F("abcde")
    assert d.derivation("ad", "e", fds) == [(F("a"), F("b")), (F("b"), F("c")), (F("cd"), F("e"))]
    assert d.derivation("a", "e", fds) == []


def test_closures_with_nulls_and_provenance():
    fds = d.make([("a", "b"), ("b", "c"), ("c", "e")])
    assert d.null_free_closure("a", fds, F("b")) == F("abc")
    assert d.null_free_closure("a", fds, F()) == F("ab")
    assert d.strong_weak_closure("a", d.make([("a", "b")]), d.make([("b", "c"), ("c", "e")])) == F("abc")
    assert d.provenance_closure("a", fds, lambda det, dep: dep != "e") == F("abc")
    assert d.provenance_closure("a", fds, lambda det, dep: False) == F("ab")
    sources = {"t": F("ab"), "u": F("bce")}
    assert d.weak_closure("a", fds, d.together(sources)) == F("abc")


def test_candidate_keys_are_brute_force():
    r = random.Random(1)
    for _ in range(200):
        attrs = F("abcdef"[: r.randint(2, 6)])
        fds = d.projected(random_fds(r, attrs), attrs)
        supers = [s for s in subsets(attrs) if d.is_super_key(s, attrs, fds)]
        keys = {s for s in supers if not any(t < s for t in supers)}
        assert set(d.candidate_keys(attrs, fds)) == keys
    assert d.key_by_dependencies("abc", d.make([("a", "bc"), ("ab", "c"), ("c", "a")])) == F("ab")
    assert d.candidate_keys("abc", d.make([("a", "bc"), ("b", "ac")]), excluded="a") == [F("b")]


def test_canonical_cover_is_equivalent_and_minimal():
    r = random.Random(2)
    for _ in range(200):
        fds = random_fds(r, F("abcde"))
        cover = d.canonical_cover(fds)
        assert d.equivalent(cover, {k: v - k for k, v in fds.items() if v - k})
        for det, a in d.split(cover):
            rest = d.make((x, [y]) for x, y in d.split(cover) if (x, y) != (det, a))
            assert a not in d.closure(det, rest)
            assert all(a not in d.closure(det - {x}, cover) for x in det)
        assert d.equivalent(d.minimised(fds), cover)


def test_difference_and_changes():
    fds = d.make([("a", "bc"), ("b", "c")])
    assert d.not_in(fds, d.make([("a", "b")])) == {F("a"): F("c"), F("b"): F("c")}
    s = d.DependencySet(fds, "abcd")
    s.invalidate(F("b"), "c", specialise=True)
    assert s.fds == {F("a"): F("bc"), F("bd"): F("c")} and s.consistent()
    s.propagate(F("ad"), F("a"))
    assert s.fds[F("ad")] == F("bc")
    assert d.generalisations(F("ab"), F("c")) == [(F("b"), F("c")), (F("a"), F("c"))]


def test_normal_forms_are_lossless():
    r = random.Random(3)
    for _ in range(150):
        attrs = F("abcdef"[: r.randint(3, 6)])
        fds = random_fds(r, attrs)
        fds = {det & attrs: (dep & attrs) - det for det, dep in fds.items() if det <= attrs and (dep & attrs) - det}
        for relations in (d.second_normal_form(attrs, fds), d.third_normal_form(attrs, fds), d.boyce_codd_normal_form(attrs, fds)):
            assert F().union(*(a for a, _ in relations)) == attrs
            assert any(k <= a for a, _ in relations for k in d.candidate_keys(attrs, fds))
        for a, _ in d.third_normal_form(attrs, fds):  # 3NF: a non-trivial determinant is a key, or the dependant prime
            keys = [k for k in subsets(a) if a <= d.closure(k, fds)]
            prime = F().union(*(k for k in keys if not any(q < k for q in keys)))
            assert all(a <= d.closure(x, fds) or y in prime for x in subsets(a) for y in (d.closure(x, fds) & a) - x)


def test_bcnf_with_foreign_key():
    fds = d.make([(["FK", "year"], ["pop"]), (["FK"], ["name"])])
    assert d.boyce_codd_normal_form(["FK", "year", "pop", "name"], fds, "FK") == [(F({"FK", "name"}), F({"FK"})), (F({"FK", "year", "pop"}), F({"FK", "year"}))]
    assert d.with_foreign_key(fds) == {F({"FK", "year"}): F({"pop"}), F({"FK"}): F({"name"})}
    assert d.binary_dependencies(["FK", "a"]) == {F({"FK"}): F({"a"})}


def test_stitching_and_propagation():
    sources = {"big": (100, F("abc"), d.make([("a", "b")])), "small": (2, F("abc"), d.make([("a", "bc")])), "other": (50, F("bd"), d.make([("b", "d")]))}
    assert d.stitched_dependencies(sources) == {F("a"): F("b"), F("b"): F("d")}
    fds = d.make([("a", "x"), ("ab", "y")])
    assert d.propagate_over(fds, lambda s: True) == {F("a"): F("x"), F("ab"): F("xy")}
    assert d.propagate_over(fds, lambda s: True, F("b")) == fds


def test_scores_and_approximate_keys():
    good = d.violation_score(F("a"), F("b"), ["a", "b"], {"a": 2, "b": 2}, {})
    assert good > d.violation_score(F("ab"), F("c"), ["a", "b", "c"], {"a": 2, "b": 1}, {"a": "numeric"})
    unique = {F("ab"): 1.0, F("a"): 0.97, F("b"): 0.5}
    assert d.approximate_keys([F("ab")], unique.__getitem__, 0.95) == {F("a")}
