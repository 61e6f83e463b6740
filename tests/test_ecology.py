import json

from tidemill.queries import QUERIES
from tidemill.sources.ecology import Demonstration, Ecology, EcologySource, Settings, corrupted, simulate

SMALL = Settings(width=7, height=7, founders=1, initial_food=0, food_regrowth=0, max_food=20, max_population=8, memory_limit=4, perception_radius=2)


def world(**changes):
    from dataclasses import replace

    return Ecology(replace(SMALL, **changes), 1, empty=True)


def test_published_action_counts(spark, sf):
    got = {r.action: r.n for r in QUERIES["ecology_run"](spark, sf).collect()}
    assert got == {"forage": 2463, "move": 6495, "reproduce": 137, "rest": 2049, "share": 154, "signal": 316}


def test_same_seed_same_log():
    logs = []
    for _ in range(2):
        w = Ecology(Settings(founders=4, initial_food=12), 42)
        w.run(Demonstration(99), 30)
        logs.append(list(w.rows()))
    assert logs[0] == logs[1]


def test_forage_and_reproduce_energy():
    w = world()
    b = w.settle((3, 3), "a", energy=5)
    w.food[(3, 3)] = 1
    assert w.forage(b, {}) == (True, "gained 4 energy") and b.energy == 9 and not w.food
    b.energy = 20
    assert w.reproduce(b, {"target": [3, 4]})[0] and b.energy == 12
    child = w.beings["organism-00002"]
    assert (child.parent, child.generation, child.lineage) == (b.id, 1, "a")


def test_perception_is_local():
    w = world()
    b = w.settle((0, 0), "a")
    w.settle((0, 2), "b")
    w.settle((5, 5), "c")
    w.food.update({(1, 1): 1, (6, 6): 1})
    view = w.view(b)
    assert [a["id"] for a in view["visible_agents"]] == ["organism-00002"]
    assert view["visible_food"] == [{"position": [1, 1], "amount": 1}]
    assert view["open_neighbors"] == [[1, 0], [0, 1]]


def test_channels():
    assert corrupted("food at [4,2]", 7, 7) == "food at [0,5]"
    assert corrupted("hello", 7, 7) == "corrupted: hello"
    for delivery, heard in (("normal", "food at [4,2]"), ("corrupted", "food at [0,5]"), ("blocked", None)):
        w = world(signal_delivery=delivery, signal_cost=1)
        a, b = w.settle((2, 2), "a"), w.settle((2, 4), "b")
        assert w.signal(a, {"message": "food at [4,2]"})[0] and a.energy == 9
        assert b.memory == ([f"{a.id} signalled: {heard}"] if heard else [])
        assert w.log[-1][3]["delivered_message"] == heard


def test_policy_failure_is_a_rest(spark):
    def bad(view):
        raise KeyError("x")

    w = world()
    w.settle((1, 1), "a")
    w.run(bad, 1)
    data = [d for _, k, _, d in w.log if k == "decision"][0]
    assert data["action"] == {"action": "rest"} and data["policy_error"].startswith("KeyError") and "raw_output" not in data


def test_source_equals_function(spark):
    spark.dataSource.register(EcologySource)
    read = spark.read.format("ecology").option("seeds", "5-6").option("steps", "5").load()
    made = simulate(spark.createDataFrame([(5, "natural"), (6, "natural")], "seed long, condition string"), 5)
    key = ["seed", "seq"]
    assert read.orderBy(key).collect() == made.orderBy(key).collect()
    assert json.loads(read.where("kind = 'end'").first().data)["ticks"] == 5


def test_experiments(spark, sf):
    comm = {r.condition: r for r in QUERIES["communication_experiment"](spark, sf).collect()}
    assert comm["blocked"].informed_rate == 0 and comm["normal"].informed_rate == 1
    assert comm["normal"].mean_final_distance < comm["corrupted"].mean_final_distance and comm["costly"].signal_cost == 12
    effect = QUERIES["communication_effects"](spark, sf).first()
    assert effect.pairs == 12 and effect.forage_effect == 1.0
    rescue = {r.condition: r for r in QUERIES["rescue_experiment"](spark, sf).collect()}
    assert rescue["normal"].share_rate == rescue["normal"].forage_rate == 1 and rescue["blocked"].forage_rate == rescue["unsafe"].share_rate == 0
    assert rescue["blocked"].wait_rate == rescue["blocked"].survival_rate == 1 and rescue["normal"].boundary_moves == 0
    assert QUERIES["rescue_effects"](spark, sf).first().forage_effect == 1.0


def test_rescue_metrics_against_a_recount(spark):
    """Every count of a rescue run against a plain loop over its events."""
    import json
    from collections import Counter

    from tidemill.plans.experiments import rescue_events, rescue_results, rescue_scene

    seeds = range(900, 903)
    runs = {(r.seed, r.condition): r for r in rescue_results(spark, seeds).collect()}
    events = {}
    for e in rescue_events(spark, seeds).orderBy("seed", "condition", "seq").collect():
        events.setdefault((e.seed, e.condition), []).append((e.tick, e.kind, e.actor_id, json.loads(e.data)))
    assert events.keys() == runs.keys()
    for key, rows in events.items():
        scene, r = rescue_scene(key[0]), runs[key]
        made = [(a, d) for _, k, a, d in rows if k == "decision" and a in (scene["child_id"], scene["donor_id"])]
        assert r.model_decisions == len(made) and r.valid_model_decisions == sum(d["valid"] and "policy_error" not in d for _, d in made)
        for role in ("child", "donor"):
            assert r[f"{role}_actions"] == Counter(d["action"]["action"] for a, d in made if a == scene[f"{role}_id"])
        given = [1 for _, k, a, d in rows if k == "share" and a == scene["donor_id"] and d["target"] == scene["child_id"]]
        assert r.shares == len(given) and r.repeated_shares == max(0, len(given) - 1) and r.unsafe_shares == (len(given) if key[1] == "unsafe" else 0)
        food = [scene["target_x"], scene["target_y"]]
        own = [d["observation"]["self"] for a, d in made if a == scene["child_id"]]
        assert r.child_reached_food == (any(x["position"] == food for x in own) or [r.child_final_x, r.child_final_y] == food)
        left = [d["observation"]["self"]["energy"] for a, d in made if a == scene["donor_id"]]
        assert r.least_donor_energy == min([r.donor_final_energy, *left])


def test_policies_compared(spark):
    """The comparison against a plain loop over the worlds, random choice included; ids count from 1."""
    import json

    from tidemill.sources.ecology import Ecology, Uniform

    rows = {r.condition: r for r in QUERIES["policy_comparison"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {"heuristic", "demonstration", "random"}
    settings = Settings(initial_food=55, food_regrowth=3, max_food=80, founders=4, max_population=12)
    decided = living = 0
    for seed in range(7, 11):
        world = Ecology(settings, seed)
        assert sorted(world.beings) == [f"organism-{i:05d}" for i in range(1, 5)] and {b.lineage for b in world.beings.values()} == {f"lineage-{i:02d}" for i in range(1, 5)}
        world.run(Uniform(seed + 100), 40)
        log = [(kind, json.loads(data)) for _, _, kind, _, data in world.rows()]
        decided += sum(k == "decision" for k, _ in log)
        living += sum(b.alive for b in world.beings.values())
        assert all(list(d) == sorted(d) for _, d in log)
    assert (rows["random"].decisions, rows["random"].living) == (decided, living)
    h = rows["heuristic"]  # the published row
    assert (h.decisions, h.valid, h.births, h.deaths, h.living, h.surviving_lineages, h.mean_energy) == (764, 764, 11, 7, 20, 16, 7.275)


def test_published_summaries(spark):
    """Seed 7, four founders, 30 steps: the published rows of the heuristic and of random choice."""
    from tidemill.operators.worlds import world_summary
    from tidemill.plans.experiments import scenarios
    from tidemill.sources.ecology import Heuristic, Uniform, simulate

    settings = Settings(initial_food=55, food_regrowth=3, max_food=80, founders=4, max_population=12)
    kinds = {"heuristic": Heuristic, "random": Uniform}
    events = simulate(scenarios(spark, [7], tuple(kinds)), 30, settings, lambda seed, condition: kinds[condition](seed + 100))
    rows = {r.condition: (r.ticks, r.born, r.died, r.living, r.mean_living_energy) for r in world_summary(events).collect()}
    assert rows == {"heuristic": (30, 1, 1, 4, 10.5), "random": (14, 0, 4, 0, 0.0)}


def test_names_tell_no_role():
    from tidemill.plans.experiments import communication_scene, rescue_scene

    scenes = [communication_scene(s) for s in range(100, 140)]
    first = [s["sender_id"] < s["recipient_id"] for s in scenes]
    assert 8 < sum(first) < 32 and len({s["sender_id"] for s in scenes}) == 40
    assert len({tuple(sorted(("child_id", "donor_id", "bystander_id"), key=rescue_scene(s).get)) for s in range(900, 960)}) == 6


def test_profiles_differ_in_cues_only():
    from tidemill.plans.experiments import PROFILES, QUIET, communication_scene, communication_world

    def views(seed, profile):
        world, scene = communication_world(QUIET, seed, "normal", profile), communication_scene(seed, profile)
        return [world.view(world.beings[scene[f"{role}_id"]]) for role in ("sender", "recipient")]

    for seed in range(100, 130):
        (matched, _), (clean, _) = views(seed, "matched"), views(seed, "clean")
        assert matched["tick"] > 0 and matched["memory"] and clean["tick"] == 0 and not clean["memory"]
        assert matched["self"]["position"] == clean["self"]["position"] and matched["visible_food"] == clean["visible_food"]
        assert matched["self"]["id"].startswith("organism-s") and clean["self"]["id"].startswith("organism-000")
        for profile, seen in (("v4", (1, 1)), ("v41", (3, 2))):
            sender, recipient = views(seed, profile)
            assert (len(sender["visible_agents"]), len(sender["visible_food"])) == seen and not recipient["visible_food"]
            assert sender["tick"] == PROFILES[profile].first_tick(seed) >= sender["self"]["age"]
    drawn = [communication_scene(s) for s in range(200, 212)]
    assert len({(*s["standing"].values(), s["target_x"], s["target_y"]) for s in drawn}) > 8
    assert drawn == [communication_scene(s) for s in range(200, 212)]


def test_channel_effect_in_every_profile(spark, sf):
    rows = {(r.profile, r.condition): r for r in QUERIES["communication_profiles"](spark, sf).collect()}
    assert len(rows) == 16
    for profile in ("matched", "clean", "v4", "v41"):
        normal, blocked = rows[profile, "normal"], rows[profile, "blocked"]
        assert normal.signal_rate == normal.forage_rate == normal.target_rate == 1 and blocked.forage_rate == blocked.informed_rate == 0
        assert rows[profile, "costly"].signal_cost == 8 and normal.valid_rate == 1
