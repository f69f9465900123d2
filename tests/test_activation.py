"""Pointcuts, routes and activation proofs, against matching each pattern with each method."""



from tidewright.operators import activation

METHODS = "method_id int, type string, supertypes array<string>, method string, params string, annotations array<string>, type_annotations array<string>"
ROWS = [
    (1, "app.web.ShipController", ["app.Base"], "list", "()", ["GetMapping"], ["RestController"]), (2, "app.web.ShipController", ["app.Base"], "save", "(app.Ship,int)", ["PostMapping"], ["RestController"]),
    (3, "app.core.ShipService", ["app.core.Service"], "save", "(app.Ship)", ["Transactional"], ["Service"]), (4, "app.core.deep.Dock", [], "saveAll", "(List,String)", [], []), (5, "app.core.ShipService$Inner", [], "find", "()", [], []),
    (6, "lib.Tool", None, "run", "(int)", None, None), (7, "appx.core.Other", ["app.core.Service"], "save", "(long)", ["Audited"], []),
]
POINTS = {
    "execution(* app.core.*.*(..))": {3, 5}, "execution(* app.core..*.*(..))": {3, 4, 5}, "execution(public void app.web.ShipController.save(..))": {2}, "execution(* save*(..))": {2, 3, 4, 7}, "execution(* save(*))": {3, 7},
    "execution(* *(.., int))": {2, 6}, "execution(* save(Ship, ..))": {2, 3}, "execution(* *(*, String))": {4}, "execution(* app.core.Service+.*(..))": {3, 7}, "within(app.core..*)": {3, 4, 5}, "within(app.web.ShipController)": {1, 2}, "@annotation(org.x.Transactional)": {3},
    "@within(RestController) && execution(* save(..))": {2}, "execution(* save(..)) && !within(app..*)": {7}, "@annotation(Audited) || (within(lib.*) && execution(* run(int)))": {6, 7}, "!(within(app..*) || within(appx..*))": {6}, "services()": {3, 4, 5}, "services() and not saves()": {5},
    "execution(* *())": {1, 5}, "execution(* find(..)) or within(none.*)": {5},
}
BAD = ["cflow(x())", "execution(", "loop()", "", "within(a.*) &&", "execution(* a.b())) "]


def clauses(spark, expressions):
    advices = spark.createDataFrame([(e, "A", e) for e in expressions], "advice string, aspect string, expression string")
    return activation.pointcuts(advices, spark.createDataFrame([("A", "services", "within(app.core..*)"), ("A", "saves", "execution(* save*(..))"), ("A", "loop", "loop() || within(a.*)"), ("B", "x", "within(b.*)")], "aspect string, name string, expression string"))


def test_pointcuts_select_the_methods_they_say(spark):
    c = clauses(spark, [*POINTS, *BAD]).cache()
    assert {r.advice for r in c.where("reason IS NOT NULL").collect()} == set(BAD) and set(r.reason for r in c.where("reason IS NOT NULL").collect()) == {activation.UNSUPPORTED}
    got = {p: set() for p in POINTS}
    for r in activation.advised(c, spark.createDataFrame(ROWS, METHODS)).collect():
        got[r.advice].add(r.method_id)
    assert got == POINTS
    # Looked up by a part wherever there is one.
    anchors = {r.advice: r.anchor for r in c.where("reason IS NULL").collect()}
    assert anchors["@annotation(org.x.Transactional)"] == "annotation" and anchors["execution(* save(*))"] == "method" and anchors["execution(* app.core..*.*(..))"] == "package" and anchors["within(app.web.ShipController)"] == "type"
    assert {p for p, a in anchors.items() if a == "any"} == {"execution(* save*(..))", "execution(* *(.., int))", "execution(* *(*, String))", "execution(* app.core.Service+.*(..))", "!(within(app..*) || within(appx..*))", "execution(* *())"}


def test_copies_of_advices_and_methods_are_matched_once(spark):
    advices = spark.createDataFrame([(f"{e}#{k}", "A", e) for e in ("execution(* save(..))", "within(lib.*)", "cflow(x())") for k in range(4)], "advice string, aspect string, expression string")
    c = activation.pointcuts(advices, spark.createDataFrame([], "aspect string, name string, expression string"))
    many = spark.createDataFrame([(r[0] + 10 * k, *r[1:]) for r in ROWS for k in range(5)], METHODS)
    asked, met, members = activation.advised_classes(c, many)
    assert met.count() == 4 and asked.count() == 8 and members.count() == 35
    want = {(f"{e}#{k}", m + 10 * j) for e, ms in (("execution(* save(..))", (2, 3, 7)), ("within(lib.*)", (6,))) for k in range(4) for m in ms for j in range(5)}
    got = activation.advised(c, many).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_filters_meet_routes(spark):
    routes = {1: "/api/ships", 2: "/api/ships/{id}", 3: "api/docks/{dock}/ships", 4: "/", 5: "/login", 6: "/{any}/x", 7: "/api/a.b"}
    filters = {"/**": {1, 2, 3, 4, 5, 6, 7}, "/api/**": {1, 2, 3, 6, 7}, "/api/*": {1, 6, 7}, "/api/ships/*": {2}, "/api/ships/7": {2}, "/api/docks/**": {3}, "/login": {5}, "/z/x": {6}, "/api/*/4/ships": {3}, "/api/a?b": set(), "/api/a.b": {7}, "/**/ships": {1, 3}, "/api/{v}": {1, 6, 7}}
    filters["/**/ships"] |= {2}  # a variable may be anything
    df = spark.createDataFrame
    got = {p: set() for p in filters}
    for r in activation.filtered(df([(p, p) for p in filters], "filter_id string, pattern string"), df(list(routes.items()), "method_id int, route string")).collect():
        got[r.filter_id].add(r.method_id)
    assert got == filters


def test_candidates_and_proof_in_one_table(spark):
    df = spark.createDataFrame
    methods = df([(1, "business", False), (2, "business", True), (3, "dependency", False), (4, "business", False)], "method_id int, owner_type string, test boolean")
    entries = df([("a", 1, "aop"), ("a", 2, "aop"), ("b", 3, "aop"), ("c", 4, "route"), ("c", 4, "route")], "record_id string, method_id int, kind string")
    records = df([("a", "p", "s", "e"), ("b", "p", "s", "e"), ("c", "p", "other", "e"), ("d", "q", "s", "e"), ("bad", "p", "s", "e")], "record_id string, path string, sha256 string, entry string")
    got = activation.framework_candidates(entries, methods, records, df([("p", "s", "e")], "path string, sha256 string, entry string"), df([("bad", activation.UNSUPPORTED)], "record_id string, reason string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "aop", True, None), ("b", None, None, False, activation.UNMATCHED), ("bad", None, None, False, activation.UNSUPPORTED), ("c", 4, "route", False, activation.UNPROVEN + ":content_differs"), ("d", None, None, False, activation.UNMATCHED)]
    assert [tuple(r) for r in activation.activation_edges(got, df([("a", "advice.log()"), ("c", "x")], "record_id string, callee string")).collect()] == [(1, "advice.log()", "aop")]
    assert {r.reason: r.records for r in activation.unproven(got).collect()} == {activation.UNMATCHED: 2, activation.UNSUPPORTED: 1, activation.UNPROVEN + ":content_differs": 1}
