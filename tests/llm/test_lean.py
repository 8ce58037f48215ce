"""What Python workers and readers hold between and during stages."""

import pyarrow as pa

from loomline.llm import _spark, jaccard_join, packing


def test_a_tokenizer_goes_when_a_worker_takes_up_other_work(spark):
    """One worker packs and then makes sets: the tokenizer and its memo must not stay beside the sets."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")

    def both(batches):
        from loomline.llm import packing

        for batch in batches:
            for op in (packing.pack, jaccard_join.jaccard_join):
                func = FUNCS[op.__name__]
                list(func(iter([batch])))
                yield pa.RecordBatch.from_pydict({"step": [op.__name__], "held": [path in packing._tokenizers]})

    FUNCS = {"pack": _mapped(packing.pack, spark, path), "jaccard_join": _mapped(jaccard_join.jaccard_join, spark)}
    docs = _spark.texts(spark.createDataFrame([(1, "some words of a text that is long enough")], "doc_id long, text string"))
    got = {r.step: r.held for r in docs.coalesce(1).mapInArrow(both, "step string, held boolean").collect()}
    assert got == {"pack": True, "jaccard_join": False}


def _mapped(op, spark, *args):
    """The first function that an operator gives to mapInArrow."""

    class Seen(Exception):
        pass

    found = []
    frame = type(spark.range(0))
    before = frame.mapInArrow

    def seen(self, f, *a, **k):
        found.append(f)
        raise Seen

    frame.mapInArrow = seen
    try:
        op(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), *args)
    except Seen:
        pass
    finally:
        frame.mapInArrow = before
    return found[0]


def test_few_texts_are_read_at_once(spark):
    """A read batch of 4,096 whole texts is an array of many MB for each task; a session's own number stays."""
    before = spark.conf.get(_spark.READ)
    try:
        spark.conf.set(_spark.READ, "4096")
        _spark.texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        assert int(spark.conf.get(_spark.READ)) <= 1000
        spark.conf.set(_spark.READ, "2000")
        _spark.modest(spark)
        assert spark.conf.get(_spark.READ) == "2000"
    finally:
        spark.conf.set(_spark.READ, before)
