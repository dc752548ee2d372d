"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""
