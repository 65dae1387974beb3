import numpy as np
import pyarrow as pa

from marketframe.llm import phrases


class Seen:
    """Stands for a table: keeps what a task would run."""

    def select(self, *cols):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_phrases_of_one_beginning_travel_together(spark):
    rows = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(f"the w{i}" for i in range(2000))]})
    seen = Seen()

    class Every:
        def look(self, keys):
            return np.ones(len(keys), bool)

    try:
        phrases.counted(seen, 2, Every())
    except AttributeError:  # the stand-in has no shuffle
        pass
    made = [r for b in seen.run(iter([rows])) for r in b.to_pylist()]
    assert sum(len(r["rests"].split("\n")) for r in made if r["first"] == "the") == 2000
    assert sum(r["first"] == "the" for r in made) == phrases.SALTS
