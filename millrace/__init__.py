"""millrace: a catalogue analytics library of Spark DataFrame operators."""
