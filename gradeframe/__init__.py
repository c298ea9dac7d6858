"""gradeframe: exam grading and score-agreement analytics on Spark DataFrames.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing here runs an action unless its docstring says so.
"""
