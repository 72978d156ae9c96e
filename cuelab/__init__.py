"""cuelab: build, run and score cue-labelled text datasets on Spark."""
