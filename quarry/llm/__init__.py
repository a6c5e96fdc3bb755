"""Operations of a training-data pipeline; nothing else in quarry imports this subpackage."""
