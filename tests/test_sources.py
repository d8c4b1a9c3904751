from pyspark.sql import functions as F

from ashlar.functions import rules
from ashlar.operators import metrics, smells
from ashlar.plans import suggest
from ashlar.sources import models, pysource

MODEL = """class Order < ApplicationRecord
  belongs_to :customer
  has_many :lines, dependent: :destroy
  validates :total, presence: true, numericality: { greater_than: 0 }
  validates :code, length: { maximum: 10 }
  validates :note
  before_save :round_total
  after_create :notify
  scope :open, -> { where(open: true) }
end
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_models(spark):
    f = files(spark, ("order.rb", MODEL), ("plain.rb", "class Plain < Base\n  before_save :x\nend"), ("none.rb", "puts 1"), ("null.rb", None), ("empty.rb", ""))
    declared = {(r.model, r.kind, r.type, r.name) for r in models.declarations(f).collect()}
    order = {(k, t, n) for m, k, t, n in declared if m == "Order"}
    assert order == {
        ("validation", "presence", "total"), ("validation", "numericality", "total"), ("validation", "length", "code"), ("validation", "custom", "note"),
        ("association", "belongs_to", "customer"), ("association", "has_many", "lines"), ("callback", "before_save", "round_total"), ("callback", "after_create", "notify"), ("scope", "scope", "open"),
    }
    nodes, edges = models.compiled(f)
    assert {r.id for r in nodes.where("model = 'Plain'").collect()} == {"Plain_create_entry", "Plain_update_entry", "Plain_destroy_entry", "Plain_before_save_x", "Plain_persist"}
    assert nodes.where("model = 'Order'").count() == 3 + 4 + 2 + 1
    line = {r.src: (r.dst, r.edge_type) for r in edges.collect()}
    at, seen = "Order_create_entry", []
    while at in line:
        at, kind = line[at]
        seen.append((at, kind))
    assert seen == [
        ("Order_validate_total_presence_0", "TRIGGERS"), ("Order_validate_total_numericality_1", "FEEDS"), ("Order_validate_code_length_2", "FEEDS"), ("Order_validate_note_custom_3", "FEEDS"),
        ("Order_before_save_round_total", "TRIGGERS"), ("Order_after_create_notify", "TRIGGERS"), ("Order_persist", "FEEDS"),
    ]
    assert edges.where("model = 'Plain'").count() == 0


ODD = """# class Wrong < Base
class Shop::Item < ::Core::Record # the item
  validates :name, :code,
            presence: true,
            length: { maximum: 5 } # both
  has_many :parts, dependent: :destroy
  belongs_to(:shop)
  before_save :a, :b
  label = "validates :fake, presence: true # no"
  # validates :gone, presence: true
end
"""


def test_statements_over_lines_comments_and_namespaces(spark):
    f = files(spark, ("item.rb", ODD))
    declared = models.declarations(f).collect()
    assert {r.model for r in declared} == {"Shop::Item"}
    assert sorted((r.kind, r.type, r.name) for r in declared) == sorted([("validation", k, n) for n in ("name", "code") for k in ("presence", "length")] + [("association", "has_many", "parts"), ("association", "belongs_to", "shop"), ("callback", "before_save", "a"), ("callback", "before_save", "b")])
    assert {r.name: r.options for r in declared if r.kind == "association"} == {"parts": {"dependent": ":destroy"}, "shop": {}}
    nodes, edges = models.semantic(f, associations=True)
    extra = {(r.operation, r.id, r.phase) for r in nodes.collect() if "fk" in r.id or "cascade" in r.id}
    assert extra == {("create", "Shop::Item_validate_fk_shop", "validate"), ("destroy", "Shop::Item_cascade_parts", "before_callback")}
    create = {(r.src.removeprefix("Shop::Item_"), r.dst.removeprefix("Shop::Item_")) for r in edges.where("operation = 'create'").collect()}
    assert ("create_entry", "before_save_a") in create and ("before_save_a", "before_save_b") in create and ("before_save_b", "validate_code_presence_0") in create
    assert sum(dst == "persist" for _, dst in create) == 4
    lowered = models.lowered(nodes.where("operation = 'create'"), edges.where("operation = 'create'"))
    assert models.embedded(*lowered).where("size(resonance) = 157").count() == 1 + 2 + 4 + 1 + 1


CODE = '''
class A:
    def f(self, x, *, y=1):
        if x:
            for i in x:
                while i:
                    g(i)
        return self.h()

    def h(self):
        return g(2)

def g(n):
    return n
'''


def test_python_source(spark):
    rows = pysource.parsed(files(spark, ("a.py", CODE), ("b.py", "def k():\n    return g(1)\n"), ("bad.py", "def ("), ("null.py", None)))
    assert {r.path: r.error for r in rows.where("seq = 0").collect()} == {"a.py": None, "b.py": None, "bad.py": "SyntaxError", "null.py": None}
    nodes, edges = pysource.code_graph(rows)
    name = {r.id: r.name for r in nodes.collect()}
    calls = {(name[r.src], name[r.dst]) for r in edges.where("edge_type = 'CALLS'").collect()}
    assert calls == {("f", "g"), ("f", "h"), ("h", "g"), ("k", "g")}
    f = nodes.where("name = 'f'").first()
    assert (f.node_type, f.param_count, f.nesting_depth, f.line_count) == ("METHOD", 3, 3, 6)
    assert {name[r.id]: r.cyclomatic for r in metrics.cyclomatic(nodes, edges).collect()} == {"f": 4, "h": 1, "g": 1, "k": 1}
    assert name[metrics.hotspots(nodes, edges, 1).first().id] == "f"
    assert metrics.tangledness(nodes, edges).first().n_cyclic == 0
    found = smells.dead_code(nodes, edges)
    assert {name[r.id] for r in found.collect()} == {"f", "k"}
    one = metrics.score(found, metrics.quality_metrics(nodes)).first()
    assert (one.total_methods, one.total_classes, one.max_nesting, one.methods_per_class, one.score) == (4, 1, 3, 4.0, 96.0)


def test_coupling(spark):
    nodes = spark.createDataFrame([(i, b) for i, b in enumerate(["x", "x", "y", "z"])], "id long, body string")
    edges = spark.createDataFrame([(0, 1, "CALLS"), (0, 3, "CALLS"), (1, 3, "DEPENDS"), (2, 3, "CONTAINS")], "src long, dst long, edge_type string")
    got = {(r.a, r.b): round(r.coupling, 6) for r in metrics.coupled_pairs(nodes, edges).collect()}
    assert got == {(0, 1): 1.0, (0, 3): 0.5, (1, 3): 0.5}


def test_coupling_of_hubs(spark):
    import random

    random.seed(4)
    ends = {(random.choice((0, 1, random.randrange(40))), random.randrange(40)) for _ in range(260)} | {(0, i) for i in range(40)}
    nodes = spark.createDataFrame([(i, ("", "p", None, f"q{i}")[i % 4]) for i in range(40)], "id long, body string")
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in ends] + [(a, b, "DEPENDS") for a, b in list(ends)[:20]], "src long, dst long, edge_type string")
    uses = {i: {b for a, b in ends if a == i != b} for i in range(40)}
    want = {tuple(sorted(e)): round(min(1.0, 0.5 + 0.1 * len(uses[e[0]] & uses[e[1]]) + 0.4 * (e[0] % 4 == e[1] % 4 == 1)), 6) for e in ends if e[0] != e[1]}
    assert {(r.a, r.b): round(r.coupling, 6) for r in metrics.coupled_pairs(nodes, edges).collect()} == want


def test_causes_and_what_they_call_for(spark):
    rows = [("a value is NULL", 0, 0), ("value too long", 0, 1), ("value too short", 2, 1), ("duplicate key", 1, 0), ("stopped", 5, 3), (None, 0, 2)]
    df = spark.createDataFrame(rows, "error string, n long, step long").withColumn("c", rules.root_cause(F.lit("x"), F.col("error"), F.array(*map(F.lit, "abcd")), F.col("n"), F.col("step")))
    got = {r.error: (r.c.kind, r.c.sources, r.c.recurring, r.c.first_step, r.s) for r in df.withColumn("s", rules.suggestion(F.col("c"))).collect()}
    assert got == {
        "a value is NULL": ("missing_input", ["a", "b", "c"], False, True, "provide_input"), "value too long": ("length", [], False, False, "check_length"), "value too short": ("length", [], True, False, "validate_upstream"),
        "duplicate key": ("uniqueness", [], False, True, "review_path"), "stopped": ("execution", [], True, False, "validate_upstream"), None: ("execution", [], False, False, "review_path"),
    }


def test_suggestions(spark):
    rows = [("e1", "a", True, 1), ("e1", "b", True, 2), ("e2", "a", True, 3), ("e2", "c", True, 4), ("e2", "b", True, 5), ("e3", "a", True, 6), ("e3", "b", False, 7)]
    log = spark.createDataFrame([(e, n, 1.0, s, None, t) for e, n, s, t in rows], "execution_id string, node_id string, duration_ms double, success boolean, error string, ts long")
    nodes = spark.createDataFrame([("a", "VALIDATE"), ("b", "PERSIST")], "id string, node_type string")
    got = [(r.success_id, r.action, r.confidence) for r in suggest.suggest_fixes(log, nodes).collect()]
    assert got == [("e1", "check_input", 0.7), ("e2", "investigate_divergence", 0.5), (None, "check_constraints", 0.4)]
    assert suggest.suggest_fixes(log.where("success"), nodes).collect() == []
