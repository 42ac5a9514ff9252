"""weftgraph: a Spark-native analytics engine for triples, rules, surveys and text datasets."""
