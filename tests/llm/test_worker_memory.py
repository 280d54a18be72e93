"""What an operator keeps in a Python worker: its own tasks find it again, those of another operator drop it."""

from tagloom.llm import common


def run(name, made, keeps=()):
    def batches(frames):
        thing = common.kept(name, lambda: made.append(name) or object())
        yield from ((frame, thing) for frame in frames)

    return list(common.lean(batches, keeps)(iter([1, 2])))


def test_kept_things_outlive_tasks_of_their_operator_only():
    made = []
    assert run("words", made, ["words"]) == run("words", made, ["words"])
    assert made == ["words"]
    assert list(common.lean(lambda frames: frames)(iter([3]))) == [3]
    run("words", made, ["words"])
    assert made == ["words", "words"]


def test_packing_leaves_no_words_to_the_stages_that_follow(spark):
    """Workers are used again: the tasks after packing see what it kept, before and after a lean task."""
    import public_tokenizers

    from tagloom.llm.packing import pack_documents

    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string")
    pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).count()

    def names(frames):
        import sys

        import pandas as pd

        list(frames)
        state = vars(sys.modules["tagloom_worker_state"]) if "tagloom_worker_state" in sys.modules else {}
        yield pd.DataFrame({"name": ["", *(n for n in state if n.startswith("words of "))]})

    seen = docs.mapInPandas(common.lean(names), "name string").distinct().collect()
    assert [r.name for r in seen] == [""]
