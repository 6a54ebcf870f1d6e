"""Ten annotated sentences for tests and demonstrations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .reader import parse_json, to_sentences
from .schema import SchemaConfig

#: id: words, tags, lemmas, entities, root, edges (head>dependent:label)
_ROWS = """
doc_simple|John eats pizza .|NNP VBZ NN .|john eat pizza .|B-PERSON O B-FOOD O|1|1>0:nsubj 1>2:dobj 1>3:punct
doc_chase|The big dog chased the small cat|DT JJ NN VBD DT JJ NN|the big dog chase the small cat|O O B-ANIMAL O O O B-ANIMAL|3|2>0:det 2>1:amod 3>2:nsubj 3>6:dobj 6>4:det 6>5:amod
doc_ditransitive|John gave Mary a beautiful gift|NNP VBD NNP DT JJ NN|john give mary a beautiful gift|B-PERSON O B-PERSON O O O|1|1>0:nsubj 1>2:iobj 1>5:dobj 5>3:det 5>4:amod
doc_prep_chain|The cat sleeps on the soft mat in the corner|DT NN VBZ IN DT JJ NN IN DT NN|the cat sleep on the soft mat in the corner|O B-ANIMAL O O O O O O O B-LOC|2|1>0:det 2>1:nsubj 2>3:prep 3>6:pobj 6>4:det 6>5:amod 6>7:prep 7>9:pobj 9>8:det
doc_relative|Scientists who work at MIT discovered particles|NNS WP VBP IN NNP VBD NNS|scientist who work at mit discover particle|O O O O B-ORG O O|5|5>0:nsubj 0>2:relcl 2>1:nsubj 2>3:prep 3>4:pobj 5>6:dobj
doc_coordination|John and Mary love pizza and pasta|NNP CC NNP VBP NN CC NN|john and mary love pizza and pasta|B-PERSON O B-PERSON O B-FOOD O B-FOOD|3|3>0:nsubj 0>1:cc 0>2:conj 3>4:dobj 4>5:cc 4>6:conj
doc_passive|The pizza was eaten by John quickly|DT NN VBD VBN IN NNP RB|the pizza be eat by john quickly|O B-FOOD O O O B-PERSON O|3|1>0:det 3>1:nsubjpass 3>2:auxpass 3>4:agent 4>5:pobj 3>6:advmod
doc_nested_np|The president of the United States signed the bill|DT NN IN DT NNP NNP VBD DT NN|the president of the united states sign the bill|O O O O B-LOC I-LOC O O O|6|1>0:det 1>2:prep 2>5:pobj 5>3:det 5>4:compound 6>1:nsubj 6>8:dobj 8>7:det
doc_clausal|John believes Mary knows the truth|NNP VBZ NNP VBZ DT NN|john believe mary know the truth|B-PERSON O B-PERSON O O O|1|1>0:nsubj 1>3:ccomp 3>2:nsubj 3>5:dobj 5>4:det
doc_adverbial|John left because Mary arrived late|NNP VBD IN NNP VBD RB|john leave because mary arrive late|B-PERSON O O B-PERSON O O|1|1>0:nsubj 1>4:advcl 4>2:mark 4>3:nsubj 4>5:advmod
"""


def documents() -> list[dict]:
    """In the shape of the JSON input."""
    out = []
    for row in _ROWS.strip().splitlines():
        name, words, tags, lemmas, entities, root, edges = row.split("|")
        layers = zip(("word", "pos", "lemma", "entity"), (words, tags, lemmas, entities))
        fields = [{"name": k, "$type": "TokensField", "tokens": v.split()} for k, v in layers]
        graph = []
        for e in edges.split():
            ends, label = e.split(":")
            head, dependent = ends.split(">")
            graph.append([int(head), int(dependent), label])
        fields.append({"name": "dependencies", "$type": "GraphField", "edges": graph, "roots": [int(root)]})
        out.append({"id": name, "metadata": [], "sentences": [{"numTokens": len(words.split()), "fields": fields}]})
    return out


def sentences(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(json.dumps(d),) for d in documents()], "json string")
    return to_sentences(parse_json(rows, "json"), SchemaConfig(["word", "pos", "lemma", "entity"]))
