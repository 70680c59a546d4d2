"""Operations of a training-data pipeline over documents and conversations; each module is one operator."""
