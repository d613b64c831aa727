"""Operations of a training-data pipeline, each a plain function over DataFrames."""
