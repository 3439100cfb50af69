import subprocess
import sys

from pyspark import cloudpickle

from tabml.operators import cluster_metrics, knn
from tabml.sources import xlsx


def test_task_functions_need_no_package_on_the_executors():
    code = ("import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read()); "
            "assert 'tabml' not in sys.modules")
    for function in (cluster_metrics._block_sums, knn._nearest, xlsx._parse_books):
        subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(function), cwd="/", check=True)
