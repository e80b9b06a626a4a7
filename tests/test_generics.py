"""Signatures and the type arguments that chains of extends carry."""

import pytest

from skylark.operators import generics as G


@pytest.mark.parametrize(
    ("signature", "want"),
    [
        ("<K:LObject;E::LComparable<LE;>;>LObject;LCrudRepository<LE;LK;>;", (["K", "E"], [("Object", []), ("CrudRepository", ["E", "K"])])),
        ("LJpaRepository<LMap<LString;LList<LInteger;>;>;LLong;>;", ([], [("JpaRepository", ["Map<String, List<Integer>>", "Long"])])),
        ("LCrudRepository<[BLLong;>;", ([], [("CrudRepository", ["byte[]", "Long"])])), ("LCrudRepository<LList<+LNumber;>;LLong;>;", ([], [("CrudRepository", ["List<? extends Number>", "Long"])])),
        ("LObject;LJpaRepository<Lcom.acme.crm.Account;LLong;>;", ([], [("Object", []), ("JpaRepository", ["com.acme.crm.Account", "Long"])])), ("LObject;LCrudRepository;", ([], [("Object", []), ("CrudRepository", [])])),
        ("<R::LJpaRepository<LOrder;LString;>;>LObject;", (["R"], [("Object", [])])), ("LA<**>;", ([], [("A", ["?", "?"])])), ("LA<-TX;*LB<TX;>;[[J>;", ([], [("A", ["? super X", "?", "B<X>", "long[][]"])])),
        ("LA<LB<LC<*>;>;+[LD<I>;>;LE;", ([], [("A", ["B<C<?>>", "? extends D<int>[]"]), ("E", [])])),
        *[(s, None) for s in ("LObject", "LJpaRepository<LOrder;", "", "<empty>", None, "TR;", "LA;>", "[LA;", "I", "<A>LObject;", "LA<>;x", "LA<+>;", "<A:", "LA<LB;>", "L;")],
    ],
)
def test_signatures(signature, want):
    got = G.declared(signature)
    assert (got and (got["params"], [(s["name"], [a["text"] for a in s["args"]]) for s in got["supers"]])) == want


def test_deep_signatures_do_not_overflow():
    n = 100_000
    assert len(G.declared("LA<" * n + "*" + ">;" * n)["supers"]) == 1 and G.declared("LA<" * n) is None


TYPES = [
    ("a.Base", "<T:LObject;K:LObject;>LObject;LCrudRepository<TT;TK;>;", ["org.CrudRepository"]), ("a.Swapped", "<X:LObject;Y:LObject;>LObject;LBase<TY;TX;>;", ["a.Base"]),
    ("a.Orders", "LObject;LSwapped<LLong;LOrder;>;", ["a.Swapped"]), ("a.Raw", "LObject;LBase;", ["a.Base"]), ("a.Wrong", "LObject;LBase<LOrder;>;", ["a.Base"]), ("a.Wild", "LObject;LBase<+LOrder;LLong;>;", ["a.Base"]),
    ("a.Generic", "<E:LObject;>LObject;LBase<TE;LLong;>;", ["a.Base"]), ("a.Erased", "LBase<LOrd", ["a.Base"]), ("a.Plain", "LObject;", []), ("a.One", "LObject;LTwo;", ["a.Two"]), ("a.Two", "LObject;LOne;", ["a.One"]),
    ("a.Mixed", "LObject;LPlain;LOther;LBase<LLate;LLong;>;LCrudRepository<LEarly;LLong;>;", ["a.Plain", "x.Other", "a.Base", "org.CrudRepository"]), ("b.Direct", "LObject;LCrudRepository<La.Order;LLong;>;", ["org.CrudRepository"]),
    ("b.Nested", "LObject;La.Base<LPage<LOrder;>;LLong;>;", ["a.Base"]), ("c.Base", "LObject;", []), ("a.Order", "LObject;", []), ("b.Order", "LObject;", []), ("c.Late", "LObject;", []),
]


def test_bindings(spark):
    types = spark.createDataFrame(TYPES, "type string, signature string, parents array<string>")
    found = G.bindings(types, spark.createDataFrame([("org.CrudRepository",)], "marker string"))
    got = {r.type: (r.bound, r.entity) for r in G.resolved(found, types).collect()}
    assert got == {
        "a.Base": (None, None), "a.Swapped": (None, None), "a.Orders": ("Order", "a.Order"), "a.Raw": (None, None), "a.Wrong": (None, None), "a.Wild": (None, None), "a.Generic": (None, None), "a.Erased": (None, None),
        "a.Mixed": ("Late", "c.Late"), "b.Direct": ("a.Order", "a.Order"), "b.Nested": ("Page<Order>", None),
    }
